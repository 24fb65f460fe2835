"""One project's view of a store: every tool as a method over the shared tables.

Reading methods return DataFrames. Changing methods replace the tables they
touch and return what happened. :meth:`Store.publish` writes all tables as the next
snapshot, :meth:`Store.commit` only the rows that differ as the next version of a log.
Single documents and ids given by a caller are driver-side values, everything
that depends on the store's size stays in Spark.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallspark.functions.secrets import findings
from recallspark.operators import dedup, fusion, graph, index, messages, outbox, records, remotes, search, usage
from recallspark.operators.similar import derived_edges
from recallspark.plans import jobs
from recallspark.plans.recall import RecallOptions, exposures, recall, sightings
from recallspark.schema import DOCUMENT, TABLES, RecallError
from recallspark.session import settle, shared_dir
from recallspark.sources import changes, exchange, snapshots
from recallspark.sources.postings import Postings


def text_of(rows: DataFrame) -> dict[str, Column]:
    """The nine indexed fields of stored documents."""
    return index.text_fields(
        F.col("id"), F.col("description"), F.col("triggers"), F.col("tags"), F.col("labels"),
        F.col("remembered_facts"), F.col("solution_pattern"), F.col("pitfalls"),
        [F.coalesce("scope.area", F.lit("")), F.array_join("scope.files", " "), F.array_join("scope.applies_to", " ")])


class Store:
    def __init__(self, spark: SparkSession, project: str, tables: dict[str, DataFrame] | None = None,
                 replica: str = "local", actor: str | None = None):
        self.spark, self.project, self.replica, self.actor = spark, project, replica, actor
        given = tables or {}
        self.tables = {name: given.get(name, snapshots.empty(spark, name)) for name in TABLES}
        if "listing" in given:
            self.tables["listing"] = given["listing"]
        self._log: changes.ChangeLog | None = None
        self._committed: dict[str, DataFrame] = {}
        self._index: tuple | None = None
        if self._mine("projects").isEmpty():
            self._append("projects", [(project, 0, None)])

    # ------------------------------------------------------------- plumbing

    def _mine(self, name: str) -> DataFrame:
        return self.tables[name].where(F.col("project_id") == self.project)

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.tables[name] = self.tables[name].unionByName(self.spark.createDataFrame(rows, TABLES[name]))

    def _ids(self, slugs: list[str]) -> DataFrame:
        """``(project_id, id)`` for names a caller gave; all must exist."""
        wanted = self.spark.createDataFrame([(self.project, s) for s in sorted(set(slugs))], "project_id string, id string")
        missing = wanted.join(self._mine("records").select("project_id", "id"), ["project_id", "id"], "left_anti").head()
        if missing:
            raise RecallError(f"Unknown memory id: {missing['id']}")
        return self.tables["records"].join(wanted, ["project_id", "id"], "left_semi").select("project_id", "memory_id", "id")

    def _known(self) -> list[str]:
        """The project's vocabulary: maintained by hand, so small."""
        return sorted(r["label"] for r in self._mine("registry").select("label").collect())

    def publish(self, root: str, stamp: str, keep: int = 7) -> str:
        return snapshots.publish({k: v for k, v in self.tables.items() if k in TABLES}, root, stamp, keep)

    @classmethod
    def open(cls, spark: SparkSession, root: str, project: str, **options) -> Store:
        return cls(spark, project, snapshots.load(spark, root), **options)

    def commit(self, root: str, stamp: str) -> int:
        """What differs from the log's newest version as its next one; a first commit writes all tables.

        The rows that differ are found by key and hash, so what is written follows the change, not the store.
        """
        if self._log is None or self._log.root != root.rstrip("/"):
            self._log, self._committed = changes.ChangeLog(self.spark, root), {}
        held = self._log.names()
        whole = {name: self.tables[name] for name in TABLES if name not in held}
        touched = [name for name in TABLES if name in held and self._committed.get(name) is not self.tables[name]]
        rows = {name: settle(changes.difference(self._log.read(name), self.tables[name], changes.KEYS.get(name))) for name in touched}
        version = self._log.commit(stamp, whole, {name: df for name, df in rows.items() if not df.isEmpty()})
        self._committed = {name: self.tables[name] for name in TABLES}
        return version

    @classmethod
    def open_log(cls, spark: SparkSession, root: str, project: str, **options) -> Store:
        """The newest version of a change log."""
        log = changes.ChangeLog(spark, root)
        made = cls(spark, project, log.tables(), **options)
        made._log, made._committed = log, dict(made.tables)
        return made

    def reindex(self) -> None:
        """Recompute everything derived from the documents."""
        rows = self.tables["records"]
        linked = records.edges_of(rows)
        similar = derived_edges(jobs.flat(rows)).select(
            "project_id", "src", "dst", F.lit("derived").alias("kind"), F.lit(None).cast("string").alias("reason"))
        self.tables["edges"] = settle(linked.unionByName(similar))

    # -------------------------------------------------------------- reading

    def labels(self) -> DataFrame:
        return search.label_groups(self._mine("registry"))

    def get(self, slug: str) -> DataFrame:
        named = self.spark.createDataFrame([(self.project, slug)], "project_id string, slug string")
        return search.lookup(jobs.flat(self.tables["records"]), self._copies(), named)

    def _copies(self) -> DataFrame:
        return self.tables["cached"].withColumn("slug", F.col("id"))

    def search(self, label_query: object = None, statuses: object = None, text: str | None = None,
               limit: int | None = None, include_archived: bool = False) -> DataFrame:
        return search.search(jobs.flat(self.tables["records"]), self.project, label_query, set(self._known()), statuses,
                             text, limit, include_archived)

    def recent(self, before: str | None = None, after: str | None = None, limit: int = 8, offset: int = 0,
               statuses: object = None, label_query: object = None) -> DataFrame:
        return search.timeline(jobs.flat(self.tables["records"]), self.project, before, after, limit, offset, statuses,
                               label_query, set(self._known()))

    def archived(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return search.archived(jobs.flat(self.tables["records"]), self.project, limit, offset)

    def index(self) -> Postings:
        """The stored index of owned records and borrowed copies, built when first asked after either changed."""
        now = self.tables["records"], self.tables["cached"]
        if self._index is None or any(a is not b for a, b in zip(self._index[0], now)):
            keep = ["project_id", "memory_id", "live"]
            own, copies = now[0].withColumn("live", F.col("archived_at").isNull()), now[1].withColumn("live", F.lit(True))
            rows = index.index_rows(own, text_of(own), keep).unionByName(index.index_rows(copies, text_of(copies), keep))
            self._index = now, Postings.build(rows, f"{shared_dir(self.spark).rstrip('/')}/index/{uuid.uuid4().hex}", buckets=8)
        return self._index[1]

    def recall(self, query: str = "", related_to: str | None = None, label_query: object = None, statuses: object = None,
               limit: int = 8, full_count: int = 3, include_derived: bool = True, now: str | None = None) -> DataFrame:
        """Ranked answer to one question; with ``now`` it is also counted as use."""
        known = self._known()
        options = RecallOptions(label_query, frozenset(known), statuses, limit, full_count, include_derived)
        related = None if related_to is None else self._ids([related_to]).head()["memory_id"]
        asked = self.spark.createDataFrame(
            [("q", self.project, query, related)], "query_id string, project_id string, query string, related_id string")
        slots = search.resultable(jobs.flat(self.tables["records"]), self._copies())
        found = recall(self.index(), slots, self.tables["edges"], asked, options)
        if now is not None:
            found = settle(found)
            self._count(found, asked, now)
        return found

    def _count(self, found: DataFrame, asked: DataFrame, now: str) -> None:
        more = exposures(asked).withColumnRenamed("queries", "_more")
        self.tables["projects"] = self.tables["projects"].join(more, "project_id", "left").withColumn(
            "queries", F.col("queries") + F.coalesce("_more", F.lit(0))).drop("_more")
        self._use(sightings(found, self.replica, now, _day(now)))

    def _use(self, events: DataFrame) -> None:
        self.tables["usage"] = settle(usage.add_counters(self.tables["usage"], usage.fold(events)))

    def neighbourhood(self, slug: str, depth: int = 1, max_nodes: int = 25) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(self.tables["edges"], self._ids([slug]).drop("id"), depth, max_nodes)

    def duplicates(self, limit: int = 25, threshold: float = 0.6) -> DataFrame:
        pairs = dedup.duplicate_pairs(jobs.flat(self._mine("records")), self._mine("edges").where("kind = 'derived'"), threshold)
        return dedup.duplicate_report(pairs, limit)

    def usage(self) -> DataFrame:
        return usage.by_slug(self._mine("usage"), jobs.flat(self._mine("records")))

    def sources(self, enabled_only: bool = False) -> DataFrame:
        found = self.tables["remotes"]
        return (found.where("enabled") if enabled_only else found).orderBy("name")

    def promotion_targets(self, slug: str, consulted: list[str] | None = None, k: int | None = None) -> DataFrame:
        """Every enabled destination of one public record, best first (or the ``k`` best), with the secrets that would hold it back."""
        ids = self._ids([slug])
        rows = self._mine("records").join(ids.drop("id"), ["project_id", "memory_id"], "left_semi").where("visibility = 'public'")
        used = ids.select("project_id", "memory_id", F.explode(F.array(*map(F.lit, consulted))).alias("name")) if consulted else None
        held = rows.select("memory_id", F.array_join(F.transform(
            findings(outbox.published_text()), lambda f: F.concat(f["rule"], F.lit(" "), f["masked"])), "; ").alias("held"))
        chosen = fusion.choose_remote(rows, self.tables["remotes"], k, used)
        if k is None:
            chosen = fusion.complete(chosen, self.tables["remotes"], rows)
        return chosen.join(held, "memory_id")

    def add_remote(self, name: str, url: str, description: str, now: str) -> None:
        """Register a destination, enabled; a name that is there already gets the new address and description."""
        fresh = self.spark.createDataFrame([(name, url, description, True, now, None, None)], TABLES["remotes"])
        self.tables["remotes"] = settle(remotes.add(self.tables["remotes"], fresh))

    def enable_remote(self, name: str, enabled: bool = True) -> None:
        self._remote(name)
        self.tables["remotes"] = settle(remotes.enable(self.tables["remotes"], name, enabled))

    def remove_remote(self, name: str) -> int:
        """Forget a destination and what waits for it; returns how many rows waited."""
        self._remote(name)
        waiting = self.tables["outbox"].where(F.col("remote") == name).count()
        left = remotes.remove(self.tables["remotes"], self.tables["outbox"], name)
        self.tables["remotes"], self.tables["outbox"] = (settle(df) for df in left)
        return waiting

    def _remote(self, name: str) -> None:
        if self.tables["remotes"].where(F.col("name") == name).isEmpty():
            raise RecallError(f"no remote is called '{name}'")

    def outbox_status(self, limit: int = 50) -> DataFrame:
        return outbox.status(self._mine("outbox"), jobs.flat(self._mine("records")), limit)

    # ------------------------------------------------------------- changing

    def record_use(self, slugs: list[str], now: str) -> None:
        events = self._ids(slugs).select(
            "project_id", "memory_id", F.lit(self.replica).alias("replica_id"), F.lit(_day(now)).cast("long").alias("day"),
            F.lit(0).cast("long").alias("surfaced"), F.lit(0).cast("long").alias("direct"),
            F.lit(1).cast("long").alias("applied"), F.lit(now).alias("ts"))
        self._use(events)

    def add_labels(self, labels: dict[str, str]) -> DataFrame:
        rows = self.spark.createDataFrame([(self.project, k, v) for k, v in labels.items()], TABLES["registry"])
        self.tables["registry"], refused = records.add_labels(self.tables["registry"], rows)
        return refused

    def create(self, documents: list[dict] | DataFrame, now: str, visibility: str = "private") -> DataFrame:
        """Store documents and mirror their links; returns the refused ones with their errors.

        Documents come as dicts, as a table of ``body`` texts, or as typed rows.
        """
        unfit = None
        if not isinstance(documents, DataFrame):
            documents = self.spark.createDataFrame([(json.dumps(d),) for d in documents], "body string")
        if "body" in documents.columns:
            rows, unfit = records.read_bodies(documents.select(F.lit(self.project).alias("project_id"), "body"), self._known())
        else:
            rows = documents
        rows = rows.withColumn("visibility", F.lit(visibility))
        held = self.tables["records"]
        lost = settle(records.unknown_targets(rows, held))
        rows = rows.join(lost, ["project_id", "id"], "left_anti")
        accepted, refused = records.create(held, rows, self._known(), now)
        refused = refused.unionByName(lost)
        if unfit is not None:
            refused = refused.unionByName(unfit)
        queries = self.tables["projects"].select("project_id", F.col("queries").alias("tier_since_query"))
        accepted = accepted.join(queries, "project_id", "left").withColumn("author_name", F.lit(self.actor).cast("string"))
        merged = self.tables["records"].unionByName(
            accepted.select([c for c in accepted.columns if c in self.tables["records"].columns]), allowMissingColumns=True)
        refused = settle(refused)
        self.tables["records"] = settle(records.spread_links(settle(merged), held, settle(accepted.select("project_id", "id"))))
        self.reindex()
        return refused

    def update(self, slug: str, patch: dict, now: str) -> DataFrame:
        self._ids([slug])
        patches = self.spark.createDataFrame([(self.project, slug, json.dumps(patch))], "project_id string, id string, patch string")
        held = self.tables["records"]
        after, revisions, refused = records.update(held, patches, self._known(), now)
        lost = records.unknown_targets(after.where((F.col("project_id") == self.project) & (F.col("id") == slug)), after)
        refused = settle(refused.unionByName(lost))
        if not refused.isEmpty():
            return refused
        revisions = revisions.withColumn("author_name", F.lit(self.actor).cast("string"))
        self.tables["revisions"] = settle(self.tables["revisions"].unionByName(revisions, allowMissingColumns=True))
        self.tables["records"] = settle(records.spread_links(settle(after), held, patches))
        self.reindex()
        return refused

    def delete(self, slug: str, confirm: str, now: str) -> DataFrame:
        """Remove one record everywhere; returns the records whose references were cleaned.

        The promotions that were waiting for it are kept in ``cancelled``.
        """
        if slug != confirm:
            raise RecallError("confirm must exactly match the id.")
        self._ids([slug])
        doomed = self.spark.createDataFrame([(self.project, slug, confirm)], "project_id string, id string, confirm string")
        left = records.delete(doomed, self.tables["records"], self.tables["edges"], self.tables["usage"],
                              self.tables["outbox"], now)
        left = {name: settle(df) for name, df in left.items()}
        self.tables["revisions"] = self.tables["revisions"].unionByName(left.pop("revisions"), allowMissingColumns=True)
        cleaned = left.pop("cleaned")
        self.cancelled = left.pop("cancelled")
        self.tables.update(left)
        return cleaned

    def merge(self, keep: str, merge: str, reason: str, now: str) -> None:
        if keep == merge:
            raise RecallError(f"'{keep}' was named on both sides of the merge")
        if not (reason or "").strip():
            raise RecallError("say why the two are merged")
        self._ids([keep, merge])
        pair = self.spark.createDataFrame(
            [(self.project, keep, merge, reason)], "project_id string, keep_id string, merge_id string, reason string")
        done = records.merge(self.tables["records"], self.tables["usage"], pair, now)
        done = {name: settle(df) for name, df in done.items()}
        self.tables["revisions"] = self.tables["revisions"].unionByName(done["revisions"], allowMissingColumns=True)
        self.tables["usage"] = done["usage"]
        named = pair.select("project_id", F.col("keep_id").alias("id"))
        self.tables["records"] = settle(records.spread_links(done["records"], self.tables["records"], named))
        self.reindex()

    def archive(self, slugs: list[str], now: str | None) -> None:
        """Take records out of the working set, or put them back with ``now=None``."""
        self.tables["records"] = settle(records.set_archived(self.tables["records"], self._ids(slugs), now))

    def set_visibility(self, slug: str, visibility: str) -> None:
        self.tables["records"] = settle(
            records.set_visibility(self.tables["records"], self._ids([slug]), visibility))

    def promote(self, slug: str, remote: str, now: str, force: bool = False, allow_secrets: bool = False) -> str:
        """Queue one record for one remote, or raise with the rule that refuses it."""
        asked = self.spark.createDataFrame(
            [(self.project, slug, remote, force, allow_secrets)],
            "project_id string, slug string, remote string, force boolean, allow_secrets boolean")
        own = jobs.flat(self.tables["records"])
        state = outbox.publication_state(own, self._copies())
        bodies = own.select("project_id", "memory_id", outbox.published_text().alias("text"))
        row = outbox.gate(asked, state, bodies, self.tables["remotes"])
        outcome = row.head()["outcome"]
        if outcome != "queued":
            raise RecallError(f"'{slug}' cannot be published: {outcome}")
        queue = outbox.enqueue(self.tables["outbox"], row, now)
        self.tables["outbox"] = settle(queue.select(*self.tables["outbox"].columns))
        return outcome

    def send(self, to: str, body: str, message_id: str, now: str, about: str | None = None, reply_to: str | None = None) -> str:
        out = self.spark.createDataFrame([(message_id, self.actor, to, body, now)],
                                         "id string, from_client string, to_name string, body string, sent_at string")
        done = messages.send(out, self.tables["messages"], self.tables["clients"])
        row = done.head()
        if row["outcome"] == "sent":
            self._append("messages", [(message_id, self.project, self.actor, self.actor, None, row["to_client"], row["body"],
                                       about, reply_to, now, None)])
        return row["outcome"]

    def inbox(self, client: str, unread_only: bool = True, mark_read_at: str | None = None) -> DataFrame:
        """A client's newest messages; with a stamp, those shown count as read from then on."""
        shown = messages.inbox(self.tables["messages"].where(F.col("to_client") == client), unread_only)
        if mark_read_at is not None:
            shown = settle(shown)
            self.tables["messages"] = settle(messages.mark_read(self.tables["messages"], shown, mark_read_at))
        return shown

    def run_jobs(self, kinds: list[str], now: str, **options: dict) -> None:
        self.tables = jobs.run(self.spark, self.tables, kinds, now, **options)

    def export(self, path: str, now: str) -> None:
        exchange.export(self.tables["records"], self.tables["registry"], self.tables["usage"], path, now, self.project)

    def restore(self, incoming: dict[str, DataFrame], now: str) -> None:
        held = {name: self.tables[name] for name in ("records", "registry", "usage")}
        after = exchange.restore(held, incoming, now)
        self.tables.update({name: settle(df) for name, df in after.items()})
        self.reindex()


def _day(stamp: str) -> int:
    """Day ordinal of a stamp, 0001-01-01 being day 1."""
    return datetime.strptime(stamp, "%Y-%m-%dT%H:%M:%SZ").toordinal()
