"""Registered queries: fusion, routing, cache, outbox, mail, validation, secrets, changes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallspark.functions import secrets
from recallspark.functions.rank import top_k
from recallspark.operators import audit, bodies, cache, fusion, index, messages, outbox, records, usage, validate
from recallspark.session import settle, shared_dir
from recallspark.sources import testdata as src
from recallspark.streaming import usage_stream
from recallspark.suite import lifecycle
from recallspark.suite.ctes import sql, tokens as sql_tokens
from recallspark.suite.ranking import corpus

NOW = "2024-02-20T00:00:00Z"
KNOWN = sorted([*(f"source:src{i}" for i in range(10)), "size:small", "size:medium", "size:large", "kind:rated"])


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Each source ranks its own records by its own statistics; the lists are fused."""
    per_source = index.bm25(corpus(spark, sf), src.queries(spark, sf), limit=20, stats_by=["area"], partition=["area"])
    ranked = per_source.select(
        "query_id", F.col("area").alias("source"), (F.col("rn") - 1).alias("rank"),
        F.col("memory_id").alias("uuid"), F.col("memory_id").alias("slug"))
    return fusion.fuse(ranked, 10).select(
        "query_id", "rn", "key", "source", F.array_join("sources", ",").alias("sources"), "fused_score")


def fuse_agreeing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as ranked lists of parts: one list per year, fused by agreement."""
    l = src.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("query_id"), F.year("l_shipdate").cast("string").alias("source"),
        F.col("l_partkey").cast("string").alias("uuid")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    ranked = top_k(l, ["query_id", "source"], [F.col("v").desc(), F.col("uuid")], 10)
    ranked = ranked.select("query_id", "source", (F.col("rn") - 1).alias("rank"), "uuid", F.col("uuid").alias("slug"))
    return fusion.fuse(ranked, 5).select("query_id", "rn", "key", "source", "fused_score")


def choose_remote(spark: SparkSession, sf: str) -> DataFrame:
    own = src.memories(spark, sf, reading=True).where("visibility = 'public'")
    used = own.where(F.col("doc_id") % 9 == 0).select(
        "project_id", "memory_id", F.concat(F.lit("remote-"), (F.col("doc_id") % 40).cast("string")).alias("name"))
    return fusion.choose_remote(own, src.remotes(spark, sf), k=2, consulted=used).select(
        "project_id", "memory_id", "place", "name", "consulted", "description_match")


def choose_remote_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Every source that has to do with a public record, best first, and after them all names once (record null)."""
    own = src.memories(spark, sf, reading=True).where("visibility = 'public'")
    used = own.where(F.col("doc_id") % 9 == 0).select(
        "project_id", "memory_id", F.concat(F.lit("remote-"), (F.col("doc_id") % 40).cast("string")).alias("name"))
    columns = ["memory_id", "place", "name", "consulted", "description_match", "why"]
    rest = fusion.rest_of_remotes(src.remotes(spark, sf))
    return fusion.choose_remote(own, src.remotes(spark, sf), consulted=used).select(*columns).unionByName(
        rest.select("place", "name"), allowMissingColumns=True)


def cache_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of copies: every other one is fetched again under a new name."""
    held = src.cached(spark, sf).withColumn("created", F.col("cached_at"))
    k = F.regexp_extract("slug", r"(\d+)$", 1).cast("long")
    again = held.where(k % 2 == 0).select(
        "project_id", "memory_id", F.concat("slug", F.lit("-new")).alias("slug"), F.lit("stale").alias("status"),
        F.concat(F.lit("again "), F.length("description").cast("string")).alias("description"), "labels",
        F.lit("mirror").alias("origin"), F.lit("2025-01-01T00:00:00Z").alias("created"),
        F.lit("2025-01-01T00:00:00Z").alias("cached_at"))
    done = cache.refresh(held.select(again.columns), again)
    return done.select("memory_id", "slug", "status", "origin", "created", "cached_at",
                       F.length("description").cast("long").alias("chars"))


def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    held = src.cached(spark, sf)
    kept = cache.retained(held, NOW, older_than_days=30, keep_most_recent=40)
    return cache.evicted(held, kept).select("project_id", "slug", "cached_at")


def publication_state(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.publication_state(src.memories(spark, sf), src.cached(spark, sf))


def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    own, copies = src.memories(spark, sf), src.cached(spark, sf)
    k = F.regexp_extract("slug", r"(\d+)$", 1).cast("long")
    names = own.select("project_id", "slug").union(copies.select("project_id", "slug"))
    asked = names.select(
        "project_id", "slug", F.concat(F.lit("remote-"), (k % 60).cast("string")).alias("remote"),
        (k % 7 == 0).alias("force"), (k % 2 == 0).alias("allow_secrets"))
    bodies = src.memories(spark, sf, reading=True).select("project_id", "memory_id", F.col("description").alias("text"))
    return outbox.gate(asked, outbox.publication_state(own, copies), bodies, src.remotes(spark, sf)).select(
        "project_id", "slug", "remote", "outcome")


def outbox_classify(spark: SparkSession, sf: str) -> DataFrame:
    own = src.memories(spark, sf, reading=True)
    return outbox.classify(src.outbox(spark, sf), own, src.remotes(spark, sf), F.col("description")).select(
        "id", "name", "remote", "attempts", "action")


def outbox_after(spark: SparkSession, sf: str) -> DataFrame:
    """The queue after a run in which every third send failed."""
    own = src.memories(spark, sf, reading=True)
    done = outbox.classify(src.outbox(spark, sf), own, src.remotes(spark, sf), F.col("description"))
    failed = src.outbox(spark, sf).where(F.col("id") % 3 == 0).select("id", F.lit("unreachable").alias("error"))
    left = outbox.after_delivery(done, failed)
    return left.groupBy("remote", "attempts").agg(F.count("*").alias("n"), F.count_if(
        F.col("last_error") == "unreachable").alias("failed"))


def outbox_job(spark: SparkSession, sf: str) -> DataFrame:
    """What destinations hold and what still waits after two runs over the same queue, one destination being out of reach."""
    own = src.memories(spark, sf, reading=True)
    folder = f"{shared_dir(spark).rstrip('/')}/remotes/{uuid.uuid4().hex}"
    url = F.when(F.col("name") == "remote-7", F.lit("nowhere://remote-7")).otherwise(F.concat(F.lit(folder + "/"), "name"))
    remotes = src.remotes(spark, sf).withColumn("url", url)
    done = settle(outbox.classify(src.outbox(spark, sf), own, remotes, F.col("description")))
    bodies = own.select("project_id", "memory_id", F.length("description").alias("chars"))
    failed, outcome = outbox.deliver(done, bodies, remotes, "first", NOW)
    outbox.deliver(done, bodies, remotes, "second", NOW)  # the queue of the first run was never put back
    left = outbox.after_delivery(done, failed)
    held = None
    for name in sorted(n for n, error in outcome.items() if error is None):
        rows = outbox.delivered(spark, f"{folder}/{name}").withColumn("remote", F.lit(name))
        held = rows if held is None else held.unionByName(rows)
    landed = held.groupBy("remote").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("chars").cast("bigint").alias("chars"))
    waiting = left.groupBy("remote", "attempts").agg(F.count("*").alias("n"), F.count("last_error").alias("errors"))
    return landed.withColumn("state", F.lit("delivered")).unionByName(waiting.withColumn("state", F.lit("waiting")), allowMissingColumns=True)


def outbox_status(spark: SparkSession, sf: str) -> DataFrame:
    return outbox.status(src.outbox(spark, sf), src.memories(spark, sf)).drop("last_error")


def outbox_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """Ask for every tier-3 record twice over the existing queue; ids of new rows are not compared."""
    own = src.memories(spark, sf).where("tier >= 3")
    queue = src.outbox(spark, sf).join(own.select("project_id", "memory_id"), ["project_id", "memory_id"]).withColumn(
        "last_error", F.lit("timeout"))
    asked = own.select("project_id", "memory_id", F.lit("remote-1").alias("remote"))
    done = outbox.enqueue(queue, asked.union(asked), NOW)
    return done.groupBy("remote").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("attempts").cast("long").alias("attempts"),
        F.count_if(F.col("queued_at") == NOW).alias("asked"), F.count("last_error").alias("errors"))


def inbox(spark: SparkSession, sf: str) -> DataFrame:
    page = messages.inbox(src.messages(spark, sf))
    return page.select("to_client", "rn", "id", "from_client", "sent_at", F.length("untrusted_body").cast("long").alias("chars"))


def inbox_quota(spark: SparkSession, sf: str) -> DataFrame:
    return messages.waiting(src.messages(spark, sf))


def unread(spark: SparkSession, sf: str) -> DataFrame:
    return messages.unread(src.messages(spark, sf))


def inbox_read(spark: SparkSession, sf: str) -> DataFrame:
    mail = src.messages(spark, sf)
    done = messages.mark_read(mail, messages.inbox(mail, limit=5), "2024-07-01T00:00:00Z")
    return done.groupBy("to_client", "read_at").agg(F.count("*").alias("n"))


def message_send(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn sent again to the next client: quotas, unknown, revoked, own and oversized."""
    mail = src.messages(spark, sf)
    k = F.regexp_extract("id", r"^(\d+)", 1).cast("long")
    outgoing = mail.select(
        F.concat(F.lit("again-"), "id").alias("id"), F.concat(F.lit("client-"), (k % 3).cast("string")).alias("from_client"),
        F.concat(F.lit("name-"), (k % 8).cast("string")).alias("to_name"), "sent_at",
        F.when(k % 10 == 0, F.lit(" ")).when(k % 11 == 0, F.repeat("body", 12)).otherwise(F.col("body")).alias("body"))
    clients = mail.select(F.regexp_extract("to_client", r"(\d)$", 1).alias("k")).distinct().select(
        F.concat(F.lit("client-"), "k").alias("client_id"), F.concat(F.lit("name-"), "k").alias("name"),
        F.when(F.col("k") == "6", F.lit("2024-01-01T00:00:00Z")).alias("revoked_at"))
    held = mail.withColumn("from_client", F.concat(F.lit("client-"), (k % 3).cast("string")))
    return messages.send(outgoing, held, clients).select("id", "from_client", "to_name", "outcome")


def validate_messages(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    return docs.select("id", F.explode(validate.document_errors(KNOWN)).alias("error"))


def validate_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Events' JSON judged as documents: everything missing, every key unknown."""
    e = src.table(spark, sf, "events").select("event_id", "props")
    return e.select("event_id", F.explode(validate.shape_errors(F.col("props"))).alias("error"))


def link_errors(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    related = records.authored_links(docs).where("kind = 'related'")
    return validate.link_errors(related, docs.withColumnRenamed("id", "slug")).distinct()


def mirror(links: DataFrame) -> DataFrame:
    """Every link with its counterpart: related both ways, supersedes against superseded_by.

    A pair of records holds one link per kind; of two reasons the smaller text is kept.
    """
    flip = F.create_map(*[F.lit(x) for pair in records.MIRROR.items() for x in pair])
    back = links.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), flip[F.col("kind")].alias("kind"), "reason")
    return links.select("project_id", "src", "dst", "kind", "reason").unionByName(back).groupBy(
        "project_id", "src", "dst", "kind").agg(F.min("reason").alias("reason"))


def mirror_links(spark: SparkSession, sf: str) -> DataFrame:
    return mirror(records.authored_links(src.documents(spark, sf))).withColumn("reason", F.coalesce("reason", F.lit("")))


def anchors_adrift(spark: SparkSession, sf: str) -> DataFrame:
    return validate.anchors_adrift(src.memories(spark, sf), src.listing(spark, sf)).select("slug", "status", "files")


def anchors_marked(spark: SparkSession, sf: str) -> DataFrame:
    own = src.memories(spark, sf)
    return validate.mark_stale(own, validate.anchors_adrift(own, src.listing(spark, sf))).groupBy(
        "project_id", "status").agg(F.count("*").alias("n"))


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = src.texts(spark, sf, "documents", "doc_id").select("doc_id", F.explode(secrets.findings(F.col("text"))).alias("f"))
    p = src.texts(spark, sf, "pages", "page_id").select("page_id", F.explode(secrets.findings(F.col("html"))).alias("f"))
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), "f.rule", "f.masked").union(
        p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")), "f.rule", "f.masked"))


def _merges(docs: DataFrame) -> DataFrame:
    """Every odd document into the even one before it, where both are in one project."""
    odd = docs.where(F.col("doc_id") % 2 == 1).select(
        "project_id", F.concat(F.lit("doc-"), (F.col("doc_id") - 1).cast("string")).alias("keep_id"),
        F.col("id").alias("merge_id"), F.lit("same lesson").alias("reason"))
    return odd


def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    done = records.merge(docs, _usage(spark, sf), _merges(docs), NOW)["records"]
    return done.select(
        "id", F.array_join("labels", ",").alias("labels"), F.array_join("triggers", ",").alias("triggers"),
        F.array_join("scope.files", ",").alias("files"), F.coalesce("archived_at", F.lit("")).alias("archived_at"),
        F.coalesce("merged_into", F.lit("")).alias("merged_into"),
        F.array_join(F.transform("relationships.related", lambda r: r["id"]), ",").alias("related"))


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return settle(usage.fold(src.usage_events(spark, sf)))


def merge_usage(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    done = records.merge(docs, _usage(spark, sf), _merges(docs), NOW)["usage"]
    return done.drop("spread_bits")


def update_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Patch every document: a scalar, a list, and one field inside an object."""
    docs = src.documents(spark, sf)
    n = F.col("doc_id")
    patch = F.when(n % 2 == 0, F.format_string(
        '{"status":"wrong","tags":["p%d"],"scope":{"area":"moved"},"evidence":{"created":null}}', n)).otherwise(
        F.format_string('{"scope":{"files":["only-%d.txt"]},"labels":["kind:rated"]}', n))
    done, _, _ = records.update(docs, docs.select("project_id", "id", patch.alias("patch")), KNOWN, NOW)
    return done.select(
        "id", "status", F.array_join("tags", ",").alias("tags"), F.array_join("labels", ",").alias("labels"),
        F.col("scope.area").alias("area"), F.array_join("scope.files", ",").alias("files"),
        F.coalesce("evidence.created", F.lit("none")).alias("created"))


#: Remainder of a document's number by 12: what is wrong with it (or right again), the messages, and those it takes the place of.
FAULTS = [
    (0, {"tags": ["a", 1]}, ["field 'tags' must contain only strings."], "field 'tags'%"),
    (1, {"extra": {"x": 1}}, ["unknown field 'extra'."], "%"),
    (2, {"relationships": {"related": [{"id": "doc-1", "reason": "Found beside it.", "weight": 1}]}},
     ["relationships.related entries must be objects with exactly 'id' and 'reason'."], "relationships.related%"),
    (3, {"scope": {"area": 5, "depth": 1}}, ["scope has unknown field 'depth'.", "scope.area must be a string."], "scope%"),
    (4, {"evidence": {"last_validated": 20240101}}, ["evidence.last_validated must be YYYY-MM-DD."], "evidence.last%"),
    (5, {"description": 12345678901234567890}, ["description must be a string of at least 20 characters."], "description%"),
    (6, {"status": 4}, ["status '4' is not one of ['active', 'stale', 'superseded', 'wrong']."], "status%"),
    (8, {"scope": {"files": ["a", "a"]}}, ["field 'scope.files' contains duplicate values."], "scope%"),
    (9, {"labels": ["kind:rated"]}, [], "label%"),
]
MOVED = (7, {"id": "moved"}, ["update cannot change an id."], "id%")


def _faulty(n: Column, faults: list[tuple]) -> Column:
    patch = F.lit("{}")
    for rest, change, _, _ in faults:
        patch = F.when(n % 12 == rest, json.dumps(change)).otherwise(patch)
    return patch


def create_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that come as JSON, most with a wrong value: what refuses each, or that it is accepted."""
    docs = src.documents(spark, sf)
    texts = docs.select("project_id", bodies.merged(records.body(docs), _faulty(F.col("doc_id"), FAULTS)).alias("body"))
    fine, refused = records.read_bodies(texts, KNOWN)
    return refused.select("id", F.explode("errors").alias("error")).unionByName(fine.select("id", F.lit("accepted").alias("error")))


def update_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """The same changes as patches of stored records: what refuses each; every revision kept is of one that was accepted."""
    docs = src.documents(spark, sf)
    patches = docs.select("project_id", "id", _faulty(F.col("doc_id"), [*FAULTS, MOVED]).alias("patch"))
    _, revisions, refused = records.update(docs, patches, KNOWN, NOW)
    kept = revisions.select(F.get_json_object("body", "$.id").alias("id"), F.lit("accepted").alias("error"))
    return refused.select("id", F.explode("errors").alias("error")).unionByName(kept)


def delete_records(spark: SparkSession, sf: str) -> DataFrame:
    """Delete every sixth document (every twelfth without the exact confirmation)."""
    docs = src.documents(spark, sf)
    doomed = docs.where(F.col("doc_id") % 6 == 0).select(
        "project_id", "id", F.when(F.col("doc_id") % 12 == 0, F.lit("no")).otherwise(F.col("id")).alias("confirm"))
    queue = src.outbox(spark, sf).join(docs.select("project_id", "memory_id"), ["project_id", "memory_id"])
    done = records.delete(doomed, docs, src.authored_edges(spark, sf), _usage(spark, sf), queue, NOW)
    counts = {name: df.groupBy("project_id").agg(F.count("*").alias("n")) for name, df in done.items()}
    left = done["records"].groupBy("project_id").agg(
        F.sum(F.size("relationships.related") + F.size("relationships.supersedes")).alias("n"))
    out = left.withColumn("what", F.lit("links"))
    for name, df in counts.items():
        out = out.unionByName(df.withColumn("what", F.lit(name)))
    return out


def create_records(spark: SparkSession, sf: str) -> DataFrame:
    """Offer every document to a store already holding a third of them."""
    docs = src.documents(spark, sf)
    held = docs.where(F.col("doc_id") % 3 == 0)
    offered = docs.drop("memory_id", "tier", "tier_since", "tier_since_query", "archived_at", "merged_into")
    accepted, refused = records.create(held, offered, KNOWN, NOW)
    return accepted.select("id", F.lit("accepted").alias("outcome"), "visibility", F.lit(0).cast("long").alias("errors"),
                           F.col("evidence.created").alias("created")).unionByName(
        refused.select("id", F.lit("refused").alias("outcome"), F.lit("").alias("visibility"),
                       F.size("errors").cast("long").alias("errors"), F.lit("").alias("created")))


def audit_apply(spark: SparkSession, sf: str) -> DataFrame:
    own, counters, edges, projects = lifecycle._inputs(spark, sf)
    found = audit.findings(own, counters, edges, projects, lifecycle.NOW, lifecycle.DELETING)
    after, gone = records.apply_audit(own, found, lifecycle.NOW)
    kept = after.join(gone, ["project_id", "memory_id"], "left_anti")
    return kept.select("slug", F.col("tier").cast("long").alias("tier"), "tier_since", "tier_since_query", "archived_at")


def registry_add(spark: SparkSession, sf: str) -> DataFrame:
    """Register every customer segment and part type as a label; spaces make some of them invalid."""
    own = src.table(spark, sf, "part").select(
        F.lit("shop").alias("project_id"), F.concat(F.lit("Type:"), F.lower("p_type")).alias("label"),
        F.lit("A part type.").alias("description"))
    names = src.table(spark, sf, "part").select(
        F.lit("shop").alias("project_id"), F.concat(F.lit("name:"), "p_name").alias("label"), F.lit("A name.").alias("description"))
    held = own.select("project_id", F.lower("label").alias("label"), "description").distinct().where("label < 'type:l'")
    done, refused = records.add_labels(held, own.union(names))
    return done.select("label", F.lit("").alias("error")).union(refused.select("label", "error").distinct())


def usage_fold_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The usage fold with events arriving as a file stream."""
    schema = src.table(spark, sf, "events").schema
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.col("lang").alias("project_id"))
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = src.as_usage(raw.select("event_id", "ts", "user_id", "event_type").join(docs, "user_id"))
    base = f"{shared_dir(spark).rstrip('/')}/usage-stream/{uuid.uuid4().hex}"
    query = usage_stream.start(events, f"{base}/days", f"{base}/progress")
    query.awaitTermination()
    return usage_stream.read(spark, f"{base}/days").withColumn(
        "spread_days", F.bit_count("spread_bits").cast("long")).drop("spread_bits")


QUERIES = {
    "rrf_fuse": rrf_fuse,
    "rrf_agreement": fuse_agreeing,
    "choose_remote": choose_remote,
    "choose_remote_complete": choose_remote_complete,
    "cache_refresh": cache_refresh,
    "cache_evict": cache_evict,
    "publication_state": publication_state,
    "promotion_gate": promotion_gate,
    "outbox_classify": outbox_classify,
    "outbox_after_delivery": outbox_after,
    "outbox_status": outbox_status,
    "outbox_job": outbox_job,
    "outbox_enqueue": outbox_enqueue,
    "inbox": inbox,
    "inbox_quota": inbox_quota,
    "inbox_unread": unread,
    "inbox_mark_read": inbox_read,
    "message_send": message_send,
    "validate_messages": validate_messages,
    "validate_shape": validate_shape,
    "link_errors": link_errors,
    "mirror_links": mirror_links,
    "anchors_adrift": anchors_adrift,
    "anchors_mark_stale": anchors_marked,
    "secret_scan": secret_scan,
    "merge_records": merge_records,
    "merge_usage": merge_usage,
    "create_refusals": create_refusals,
    "update_refusals": update_refusals,
    "update_patch": update_patch,
    "delete_records": delete_records,
    "create_records": create_records,
    "audit_apply": audit_apply,
    "registry_add": registry_add,
    "usage_fold_stream": usage_fold_stream,
}

_IDF = "ln((s.n - t.df + 0.5) / (t.df + 0.5))"
_SOURCES = {
    "located": (("memories", "cached"), """SELECT memory_id, project_id, area, archived_at IS NULL AS live FROM memories
  UNION ALL SELECT memory_id, project_id, origin, true FROM cached"""),
    "source_stats": (("located", "lengths"), "SELECT area, count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM located JOIN lengths USING (memory_id) GROUP BY 1"),
    "source_df": (("located", "postings"), "SELECT area, term, count(*)::DOUBLE AS df FROM postings JOIN located USING (memory_id) GROUP BY 1, 2"),
    "source_top": (("located", "source_stats", "source_df", "postings", "lengths", "query_terms"), f"""
SELECT query_id, area AS source, memory_id, row_number() OVER (PARTITION BY query_id, area ORDER BY raw DESC, memory_id) - 1 AS rank FROM (
  SELECT q.query_id, c.area, p.memory_id, round(sum(q.times * CASE WHEN {_IDF} <= 0 THEN 1e-6 ELSE {_IDF} END
    * p.f * 2.2 / (p.f + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl))), 9) AS raw
  FROM query_terms q JOIN postings p USING (term) JOIN located c ON c.memory_id = p.memory_id AND c.project_id = q.project_id AND c.live
  JOIN source_df t ON t.term = q.term AND t.area = c.area JOIN source_stats s ON s.area = c.area JOIN lengths l ON l.memory_id = p.memory_id
  GROUP BY 1, 2, 3) QUALIFY rank < 20"""),
}


def _fuse(ranked: str, limit: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, key) AS rn FROM (
  SELECT query_id, key, round(sum(1 / (61::DOUBLE + rank)), 12) AS raw, arg_min(source, (rank, source)) AS source,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(round(sum(1 / (61::DOUBLE + rank)), 12), 6) AS fused_score
  FROM {ranked} GROUP BY 1, 2)) WHERE rn <= {limit}"""


def _entropy(w: str) -> str:
    chars = f"string_split({w}, '')"
    share = f"(length(list_filter({chars}, lambda x: x = c))::DOUBLE / length({w}))"
    return f"list_sum(list_transform(list_distinct({chars}), lambda c: -{share} * log2({share})))"


_PATTERNS = {**secrets.SHAPES, **secrets.VENDORS}


def _found(text: str) -> str:
    safe = f"regexp_replace({text}, '{secrets.ALLOWED}', ' ', 'g')"
    parts = [f"list_transform(regexp_extract_all({safe}, '{p}'), lambda v: {{'rule': '{n}', 'masked': left(v, 4) || '...'}})"
             for n, p in _PATTERNS.items()]
    words = (f"list_filter(regexp_extract_all({safe}, '{secrets.RANDOM}'), lambda w: CASE WHEN regexp_matches(w, '{secrets.HEX}') "
             f"THEN {_entropy('w')} >= 3.0 ELSE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND {_entropy('w')} >= 4.0 END)")
    parts.append(f"CASE WHEN regexp_matches({safe}, '{secrets.NAMED}') THEN list_transform({words}, "
                 f"lambda v: {{'rule': 'random-near-name', 'masked': left(v, 4) || '...'}}) ELSE [] END")
    return f"list_distinct(flatten([{', '.join(parts)}]))"


_SECRETS = {"scanned": (("memories",), f"SELECT memory_id, length({_found('description')}) AS secrets FROM memories")}
_STATE = {"state": (("memories", "cached"), """SELECT project_id, slug, memory_id, tier, visibility, false AS borrowed FROM memories
  UNION ALL SELECT project_id, slug, min(memory_id), 0, 'public', true FROM cached c WHERE NOT EXISTS (
    SELECT 1 FROM memories m WHERE m.project_id = c.project_id AND m.slug = c.slug) GROUP BY 1, 2""")}
_CLASS = {**_SECRETS, "classified": (("outbox", "memories", "remotes", "scanned"), """
SELECT o.id, coalesce(m.slug, o.memory_id) AS name, o.remote, o.attempts,
  CASE WHEN m.memory_id IS NULL OR m.archived_at IS NOT NULL THEN 'drop' WHEN r.enabled IS NOT TRUE THEN 'skip'
       WHEN s.secrets > 0 THEN 'hold' ELSE 'send' END AS action
FROM outbox o LEFT JOIN memories m USING (memory_id) LEFT JOIN remotes r ON r.name = o.remote LEFT JOIN scanned s USING (memory_id)""")}
_REMOTE = {
    "words": (("memories",), f"""SELECT DISTINCT project_id, memory_id, unnest(list_concat(list_concat({sql_tokens('description')},
  {sql_tokens("array_to_string(triggers, ' ')")}), {sql_tokens("array_to_string(labels, ' ')")})) AS word FROM memories WHERE visibility = 'public'"""),
    "remote_words": (("remotes",), f"SELECT name, unnest(list_distinct({sql_tokens('description')})) AS word FROM remotes WHERE enabled"),
}
_DOC = {"docs": (("memories",), """SELECT *, CASE WHEN doc_id % 19 = 0 THEN list_concat(tags, tags) ELSE tags END AS doc_tags,
  CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 1 END AS facts, CASE WHEN doc_id % 23 = 0 THEN '2024/01/01' ELSE '2024-01-01' END AS validated,
  CASE WHEN doc_id % 29 = 0 THEN (doc_id % 3 <> 0)::INT + (doc_id % 4 = 0)::INT ELSE 0 END AS short_reasons,
  (doc_id % 4 = 0 AND doc_id = 0)::INT AS bad_related FROM memories""")}
_KNOWN_SQL = "[" + ", ".join(f"'{k}'" for k in KNOWN) + "]"
_ERRORS = {**_DOC, "errors": (("docs", "links"), f"""
SELECT slug AS id, 'description must be a string of at least 20 characters.' AS error FROM docs WHERE length(description) < 20
UNION ALL SELECT slug, 'field ''tags'' contains duplicate values.' FROM docs WHERE length(doc_tags) <> length(list_distinct(doc_tags))
UNION ALL SELECT slug, 'field ''remembered_facts'' must have at least 1 item(s).' FROM docs WHERE facts = 0
UNION ALL SELECT slug, 'label ''' || label || ''' is not declared in labels.json.' FROM (SELECT slug, unnest(labels) AS label FROM docs)
  WHERE NOT list_contains({_KNOWN_SQL}, label)
UNION ALL SELECT slug, 'evidence.last_validated must be YYYY-MM-DD.' FROM docs WHERE NOT regexp_matches(validated, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
UNION ALL SELECT src, 'relationships.related id must be lowercase kebab-case.' FROM links WHERE kind = 'related'
  AND NOT regexp_matches(dst, '^[a-z0-9]+(-[a-z0-9]+)*$')
UNION ALL SELECT src, 'relationships.related reason must be a string of at least 10 characters.' FROM links
  WHERE kind = 'related' AND length(reason) < 10
UNION ALL SELECT src, 'field ''relationships.supersedes'' value ''' || dst || ''' has an invalid format.' FROM links
  WHERE kind = 'supersedes' AND NOT regexp_matches(dst, '^[a-z0-9]+(-[a-z0-9]+)*$')""")}
_PAIRS = {"merge_pairs": (("memories",), """SELECT k.project_id, k.memory_id AS keep, m.memory_id AS merge, k.doc_id AS keep_doc FROM memories m
  JOIN memories k ON k.doc_id = m.doc_id - 1 AND k.project_id = m.project_id WHERE m.doc_id % 2 = 1""")}
_KEEP = lambda f, a="k", b="m": (f"CASE WHEN {b}.slug IS NULL THEN {a}.{f} ELSE list_concat({a}.{f}, "  # noqa: E731
                                 f"list_filter({b}.{f}, lambda x: NOT list_contains({a}.{f}, x))) END")
_BEFORE = {**_PAIRS, "counters": (("usage_events",), lifecycle._fold("project_id, memory_id, replica_id", "usage_events"))}
_GONE = {"gone": (("memories",), "SELECT project_id, memory_id, slug FROM memories WHERE doc_id % 6 = 0 AND doc_id % 12 <> 0"),
         "counters": _BEFORE["counters"]}
_NOT_GONE = "NOT EXISTS (SELECT 1 FROM gone g WHERE g.project_id = x.project_id AND g.{0} = x.{1})"
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_refused = lambda faults: sql(", planted(f, error, hides) AS (VALUES " + ", ".join(
    f"({rest}, {error}, {_quoted(hides)})" for rest, _, errors, hides in faults
    for error in [_quoted(e) for e in errors] or ["NULL"]) + """),
numbered AS (SELECT slug AS id, substr(slug, 5)::BIGINT % 12 AS f FROM docs),
told AS (SELECT id, error FROM numbered JOIN planted USING (f) WHERE error IS NOT NULL
  UNION ALL SELECT e.id, e.error FROM errors e JOIN numbered n ON n.id = e.id
  WHERE NOT EXISTS (SELECT 1 FROM planted p WHERE p.f = n.f AND e.error LIKE p.hides))
SELECT id, error FROM told UNION ALL SELECT slug, 'accepted' FROM docs WHERE slug NOT IN (SELECT id FROM told)""", "errors", extra=_ERRORS)
_REQUIRED = ", ".join(f"'{f}'" for f in validate.REQUIRED)

ORACLES = {
    "rrf_fuse": sql(_fuse("(SELECT *, memory_id AS key FROM source_top)", 10, "query_id, rn, key, source, sources, fused_score"),
                    "source_top", extra=_SOURCES),
    "rrf_agreement": _fuse("""(SELECT l_suppkey AS query_id, year(l_shipdate)::VARCHAR AS source, l_partkey::VARCHAR AS key,
  row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY round(sum(l_extendedprice), 2) DESC, l_partkey::VARCHAR) - 1 AS rank
  FROM lineitem GROUP BY 1, 2, 3, year(l_shipdate) QUALIFY rank < 10)""", 5, "query_id, rn, key, source, fused_score"),
    "choose_remote": sql("""
SELECT project_id, memory_id, place, name, consulted, description_match FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY consulted DESC, description_match DESC, name) AS place FROM (
    SELECT m.project_id, m.memory_id, r.name, m.doc_id % 9 = 0 AND r.name = 'remote-' || (m.doc_id % 40) AS consulted,
      round(coalesce(o.shared, 0)::DOUBLE / r.size, 3) AS description_match
    FROM memories m CROSS JOIN (SELECT name, count(*) AS size FROM remote_words GROUP BY 1) r
    LEFT JOIN (SELECT memory_id, name, count(*) AS shared FROM words JOIN remote_words USING (word) GROUP BY 1, 2) o
      ON o.memory_id = m.memory_id AND o.name = r.name WHERE m.visibility = 'public')) WHERE place <= 2""",
                         "words", "remote_words", "memories", extra=_REMOTE),
    "choose_remote_complete": sql("""
SELECT memory_id, place, name, consulted, description_match, CASE WHEN consulted THEN 'you queried this remote while solving the task'
    ELSE 'description overlap ' || CAST(round_even(match * 100, 0) AS INT) || '%' END AS why FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY consulted DESC, description_match DESC, name) AS place FROM (
    SELECT m.memory_id, r.name, m.doc_id % 9 = 0 AND r.name = 'remote-' || (m.doc_id % 40) AS consulted,
      coalesce(o.shared, 0)::DOUBLE / r.size AS match, round(coalesce(o.shared, 0)::DOUBLE / r.size, 3) AS description_match
    FROM memories m CROSS JOIN (SELECT name, count(*) AS size FROM remote_words GROUP BY 1) r
    LEFT JOIN (SELECT memory_id, name, count(*) AS shared FROM words JOIN remote_words USING (word) GROUP BY 1, 2) o
      ON o.memory_id = m.memory_id AND o.name = r.name WHERE m.visibility = 'public') WHERE consulted OR match > 0)
UNION ALL SELECT NULL, row_number() OVER (ORDER BY name), name, NULL, NULL, NULL FROM remotes WHERE enabled""",
                                  "words", "remote_words", "memories", "remotes", extra=_REMOTE),
    "cache_refresh": sql("""
SELECT memory_id, slug, CASE WHEN k % 2 = 0 THEN 'stale' ELSE status END AS status, CASE WHEN k % 2 = 0 THEN 'mirror' ELSE origin END AS origin,
  cached_at AS created, CASE WHEN k % 2 = 0 THEN '2025-01-01T00:00:00Z' ELSE cached_at END AS cached_at,
  CASE WHEN k % 2 = 0 THEN length('again ' || length(description)) ELSE length(description) END AS chars
FROM (SELECT *, CAST(regexp_extract(slug, '(\\d+)$', 1) AS BIGINT) AS k FROM cached)""", "cached"),
    "cache_evict": sql("""
SELECT project_id, slug, cached_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY cached_at DESC, memory_id) AS rn FROM cached)
WHERE rn > 40 OR cached_at < '2024-01-21T00:00:00Z'""", "cached"),
    "publication_state": sql("SELECT * FROM state", "state", extra=_STATE),
    "promotion_gate": sql("""
SELECT project_id, slug, remote, CASE WHEN visibility <> 'public' THEN 'private' WHEN borrowed THEN 'borrowed'
  WHEN tier < 2 AND NOT k % 7 = 0 THEN 'tier too low' WHEN r.enabled IS NULL THEN 'unknown remote' WHEN NOT r.enabled THEN 'remote disabled'
  WHEN NOT k % 2 = 0 AND coalesce(s.secrets, 0) > 0 THEN 'holds a secret' ELSE 'queued' END AS outcome
FROM (SELECT *, CAST(regexp_extract(slug, '(\\d+)$', 1) AS BIGINT) AS k, 'remote-' || (CAST(regexp_extract(slug, '(\\d+)$', 1) AS BIGINT) % 60) AS remote FROM state)
LEFT JOIN remotes r ON r.name = remote LEFT JOIN scanned s USING (memory_id)""", "state", "scanned", "remotes", extra={**_STATE, **_SECRETS}),
    "outbox_classify": sql("SELECT * FROM classified", "classified", extra=_CLASS),
    "outbox_after_delivery": sql("""
SELECT remote, attempts + (action = 'send')::INT AS attempts, count(*) AS n, count(*) FILTER (action = 'send') AS failed FROM classified
WHERE action <> 'drop' AND (action <> 'send' OR id % 3 = 0) GROUP BY 1, 2""", "classified", extra=_CLASS),
    "outbox_job": sql("""
SELECT remote, count(*) AS n, count(*) AS ids, sum(length(m.description))::BIGINT AS chars, 'delivered' AS state, NULL AS attempts, NULL AS errors
FROM classified c JOIN outbox o USING (id) JOIN memories m ON m.memory_id = o.memory_id WHERE action = 'send' AND c.remote <> 'remote-7' GROUP BY 1
UNION ALL SELECT remote, count(*), NULL, NULL, 'waiting', attempts + (action = 'send')::INT, count(*) FILTER (action IN ('send', 'hold')) FROM classified
WHERE action <> 'drop' AND (action <> 'send' OR remote = 'remote-7') GROUP BY remote, attempts + (action = 'send')::INT""".replace("SELECT remote,", "SELECT c.remote,", 1),
                      "classified", "outbox", "memories", extra=_CLASS),
    "outbox_status": sql("""
SELECT o.id, coalesce(m.slug, o.memory_id) AS name, remote, queued_at, attempts FROM (SELECT * FROM outbox ORDER BY id LIMIT 50) o
LEFT JOIN memories m USING (memory_id)""", "outbox", "memories"),
    "outbox_enqueue": sql("""
SELECT remote, count(*) AS n, count(*) AS ids, sum(attempts)::BIGINT AS attempts, count(*) FILTER (asked) AS asked, count(*) FILTER (NOT asked) AS errors FROM (
  SELECT o.remote, o.attempts, o.remote = 'remote-1' AS asked FROM outbox o JOIN memories m USING (memory_id) WHERE m.tier >= 3
  UNION ALL SELECT 'remote-1', 0, true FROM memories m WHERE tier >= 3 AND NOT EXISTS (
    SELECT 1 FROM outbox o WHERE o.memory_id = m.memory_id AND o.remote = 'remote-1')) GROUP BY 1""", "outbox", "memories"),
    "inbox": sql("""
SELECT to_client, rn, id, from_client, sent_at, length(body) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY to_client ORDER BY sent_at DESC, id) AS rn FROM messages WHERE read_at IS NULL) WHERE rn <= 20""", "messages"),
    "inbox_quota": sql("""SELECT from_client, to_client, count(*) AS waiting, count(*) >= 10 AS "full" FROM messages WHERE read_at IS NULL GROUP BY 1, 2""", "messages"),
    "inbox_unread": sql("SELECT to_client, count(*) AS unread FROM messages WHERE read_at IS NULL GROUP BY 1", "messages"),
    "inbox_mark_read": sql("""
SELECT to_client, coalesce(read_at, CASE WHEN rn <= 5 THEN '2024-07-01T00:00:00Z' END) AS read_at, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY to_client, read_at IS NULL ORDER BY sent_at DESC, id) AS rn FROM messages) GROUP BY 1, 2""", "messages"),
    "message_send": sql("""
, kept AS (SELECT *, CAST(regexp_extract(id, '^(\\d+)', 1) AS BIGINT) AS k FROM messages),
outgoing AS (SELECT 'again-' || id AS id, 'client-' || (k % 3) AS from_client, 'name-' || (k % 8) AS to_name, sent_at,
  CASE WHEN k % 8 < 7 THEN 'client-' || (k % 8) END AS to_client,
  CASE WHEN k % 10 = 0 THEN 'empty' WHEN k % 11 = 0 AND length(trim(repeat(body, 12), ' ' || chr(10) || chr(9))) > 4000 THEN 'too long' WHEN k % 8 = 7 THEN 'unknown recipient'
    WHEN k % 8 = 6 THEN 'recipient revoked' WHEN k % 3 = k % 8 THEN 'own client' END AS refused FROM kept),
held AS (SELECT 'client-' || (k % 3) AS from_client, to_client, count(*) AS waiting FROM kept WHERE read_at IS NULL GROUP BY 1, 2)
SELECT id, o.from_client, to_name, CASE WHEN refused IS NOT NULL THEN refused
  WHEN row_number() OVER (PARTITION BY o.from_client, o.to_client, refused IS NULL ORDER BY sent_at, id) + coalesce(waiting, 0) <= 10 THEN 'sent'
  ELSE 'too many unread' END AS outcome FROM outgoing o LEFT JOIN held h USING (from_client, to_client)""".lstrip(), "messages"),
    "validate_messages": sql("SELECT * FROM errors", "errors", extra=_ERRORS),
    "validate_shape": f"""
SELECT event_id, 'missing required field ''' || f || '''.' AS error FROM (SELECT event_id, props, unnest([{_REQUIRED}]) AS f FROM events)
WHERE NOT list_contains(json_keys(props), f)
UNION ALL SELECT event_id, 'unknown field ''' || f || '''.' FROM (SELECT event_id, unnest(json_keys(props)) AS f FROM events)
WHERE NOT list_contains([{_REQUIRED}], f)""",
    "link_errors": sql("""
SELECT DISTINCT project_id, src, dst, 'references unknown memory' AS error FROM links l WHERE kind = 'related' AND NOT EXISTS (
  SELECT 1 FROM memories m WHERE m.project_id = l.project_id AND m.slug = l.dst)
UNION ALL SELECT DISTINCT project_id, src, dst, 'is not mirrored back' FROM links l WHERE kind = 'related' AND EXISTS (
  SELECT 1 FROM memories m WHERE m.project_id = l.project_id AND m.slug = l.dst)
  AND NOT EXISTS (SELECT 1 FROM links b WHERE b.kind = 'related' AND b.project_id = l.project_id AND b.src = l.dst AND b.dst = l.src)""", "links", "memories"),
    "mirror_links": sql("""
SELECT project_id, src, dst, kind, coalesce(min(reason), '') AS reason FROM (SELECT project_id, src, dst, kind, reason FROM links
  UNION ALL SELECT project_id, dst, src, CASE kind WHEN 'supersedes' THEN 'superseded_by' ELSE kind END, reason FROM links) GROUP BY 1, 2, 3, 4""", "links"),
    "anchors_adrift": sql("""
SELECT slug, status, length(files) AS files FROM memories m WHERE archived_at IS NULL
AND len(list_intersect(files, (SELECT list(path) FROM listing))) = 0""", "memories", "listing"),
    "anchors_mark_stale": sql("""
SELECT project_id, CASE WHEN status = 'active' AND archived_at IS NULL AND len(list_intersect(files, (SELECT list(path) FROM listing))) = 0
  THEN 'stale' ELSE status END AS status, count(*) AS n FROM memories GROUP BY 1, 2""", "memories", "listing"),
    "secret_scan": f"""
SELECT slug, f.rule AS rule, f.masked AS masked FROM (SELECT 'doc-' || doc_id AS slug, unnest({_found('text')}) AS f FROM documents
  UNION ALL SELECT 'page-' || page_id, unnest({_found('html')}) FROM pages)""",
    "merge_records": sql(f"""
, rel AS (SELECT slug, string_agg(dst, ',' ORDER BY o) AS related FROM (
    SELECT src AS slug, dst, CASE WHEN CAST(regexp_extract(dst, '(\\d+)$', 1) AS BIGINT) > CAST(regexp_extract(src, '(\\d+)$', 1) AS BIGINT) THEN 0 ELSE 1 END AS o
    FROM links WHERE kind = 'related' UNION ALL
    SELECT k.slug, l.dst, 2 + row_number() OVER (PARTITION BY k.slug ORDER BY CAST(regexp_extract(l.dst, '(\\d+)$', 1) AS BIGINT) DESC)
    FROM merge_pairs p JOIN memories k ON k.memory_id = p.keep JOIN memories m ON m.memory_id = p.merge
    JOIN links l ON l.kind = 'related' AND l.src = m.slug WHERE l.dst <> k.slug AND l.dst <> m.slug
      AND NOT EXISTS (SELECT 1 FROM links kl WHERE kl.kind = 'related' AND kl.src = k.slug AND kl.dst = l.dst)) GROUP BY 1)
SELECT k.slug AS id, array_to_string({_KEEP('labels')}, ',') AS labels, array_to_string({_KEEP('triggers')}, ',') AS triggers,
  array_to_string({_KEEP('files')}, ',') AS files, CASE WHEN q.keep IS NOT NULL THEN '{NOW}' ELSE coalesce(k.archived_at, '') END AS archived_at,
  coalesce(q.keep, '') AS merged_into, coalesce(rel.related, '') AS related
FROM memories k LEFT JOIN merge_pairs p ON p.keep = k.memory_id LEFT JOIN memories m ON m.memory_id = p.merge
LEFT JOIN merge_pairs q ON q.merge = k.memory_id LEFT JOIN rel ON rel.slug = k.slug""".lstrip(), "merge_pairs", "memories", "links", extra=_PAIRS),
    "merge_usage": sql("""
SELECT project_id, memory_id, replica_id, sum(surfaced)::BIGINT AS surfaced, sum(surfaced_direct)::BIGINT AS surfaced_direct,
  sum(applied)::BIGINT AS applied, nullif(arg_max(coalesce(last_surfaced, ''), own), '') AS last_surfaced,
  nullif(arg_max(coalesce(last_applied, ''), own), '') AS last_applied, arg_max(spread_epoch, own) AS spread_epoch FROM (
    SELECT c.*, 1 AS own FROM counters c UNION ALL
    SELECT c.* REPLACE (p.keep AS memory_id), 0 FROM counters c JOIN merge_pairs p ON p.merge = c.memory_id) GROUP BY 1, 2, 3""",
                       "counters", "merge_pairs", extra=_BEFORE),
    "create_refusals": _refused(FAULTS),
    "update_refusals": _refused([*FAULTS, MOVED]),
    "update_patch": sql("""
, bad AS (SELECT slug FROM memories WHERE length(description) < 20 OR doc_id % 31 = 0 OR doc_id % 23 = 0
    OR (doc_id % 29 = 0 AND (doc_id % 3 <> 0 OR doc_id % 4 = 0)) OR (doc_id = 0) OR (doc_id % 2 = 1 AND doc_id % 19 = 0)
    OR (doc_id % 2 = 0 AND length(list_filter(labels, lambda x: NOT list_contains(""" + _KNOWN_SQL + """, x))) > 0))
SELECT slug AS id, CASE WHEN ok AND even THEN 'wrong' ELSE status END AS status,
  CASE WHEN ok AND even THEN 'p' || doc_id WHEN doc_id % 19 = 0 THEN tags[1] || ',' || tags[1] ELSE tags[1] END AS tags,
  CASE WHEN ok AND NOT even THEN 'kind:rated' ELSE array_to_string(labels, ',') END AS labels,
  CASE WHEN ok AND even THEN 'moved' ELSE area END AS area,
  CASE WHEN ok AND NOT even THEN 'only-' || doc_id || '.txt' ELSE array_to_string(files, ',') END AS files,
  CASE WHEN ok AND even THEN 'none' ELSE coalesce(created, 'none') END AS created
FROM (SELECT *, slug NOT IN (SELECT slug FROM bad) AS ok, doc_id % 2 = 0 AS even FROM memories)""".lstrip(), "memories"),
    "delete_records": sql(f"""
SELECT x.project_id, count(*) AS n, 'records' AS what FROM memories x WHERE {_NOT_GONE.format('memory_id', 'memory_id')} GROUP BY 1
UNION ALL SELECT project_id, count(*), 'revisions' FROM gone GROUP BY 1
UNION ALL SELECT x.project_id, count(*), 'edges' FROM authored x WHERE {_NOT_GONE.format('memory_id', 'src')} AND {_NOT_GONE.format('memory_id', 'dst')} GROUP BY 1
UNION ALL SELECT x.project_id, count(*), 'usage' FROM counters x WHERE {_NOT_GONE.format('memory_id', 'memory_id')} GROUP BY 1
UNION ALL SELECT x.project_id, count(*), 'outbox' FROM (SELECT m.project_id, memory_id FROM outbox JOIN memories m USING (memory_id)) x
  WHERE {_NOT_GONE.format('memory_id', 'memory_id')} GROUP BY 1
UNION ALL SELECT g.project_id, count(*), 'cancelled' FROM outbox JOIN gone g USING (memory_id) GROUP BY 1
UNION ALL SELECT x.project_id, count(DISTINCT x.src), 'cleaned' FROM links x WHERE {_NOT_GONE.format('slug', 'src')} AND NOT {_NOT_GONE.format('slug', 'dst')} GROUP BY 1
UNION ALL SELECT m.project_id, count(x.src), 'links' FROM memories m LEFT JOIN (SELECT * FROM links x WHERE {_NOT_GONE.format('slug', 'dst')}) x
  ON x.src = m.slug AND x.project_id = m.project_id WHERE m.memory_id NOT IN (SELECT memory_id FROM gone) GROUP BY 1""",
                          "memories", "gone", "authored", "counters", "outbox", "links", extra=_GONE),
    "create_records": sql(f"""
, n AS (SELECT d.slug, d.doc_id, d.created, d.visibility, (SELECT count(*) FROM errors e WHERE e.id = d.slug) + (d.doc_id % 3 = 0)::INT AS errors FROM docs d)
SELECT slug AS id, CASE WHEN errors = 0 THEN 'accepted' ELSE 'refused' END AS outcome, CASE WHEN errors = 0 THEN visibility ELSE '' END AS visibility,
  errors, CASE WHEN errors = 0 THEN coalesce(created, '{NOW}') ELSE '' END AS created FROM n""".lstrip(), "errors", "docs", extra=_ERRORS),
    "audit_apply": sql(f"""
SELECT m.slug, m.tier + (v.verdict = 'promote')::INT AS tier, CASE WHEN v.verdict = 'promote' THEN '2021-06-01T00:00:00Z' ELSE m.tier_since END AS tier_since,
  CASE WHEN v.verdict = 'promote' THEN v.queries ELSE m.tier_since_query END AS tier_since_query,
  CASE WHEN v.verdict = 'archive' THEN '2021-06-01T00:00:00Z' ELSE m.archived_at END AS archived_at
FROM memories m JOIN ({lifecycle._verdicts(True, 60, 60, 64, 40)}) v USING (project_id, slug) WHERE v.verdict <> 'delete'""",
                       "audit_evidence", "memories", extra=lifecycle._EXTRA),
    "registry_add": """
WITH types AS (SELECT DISTINCT 'type:' || lower(p_type) AS label FROM part), names AS (SELECT DISTINCT lower('name:' || p_name) AS label FROM part)
SELECT label, '' AS error FROM types UNION ALL SELECT label, 'Label already exists.' FROM types WHERE label < 'type:l'
UNION ALL SELECT label, 'Label must use prefix:kebab-case format.' FROM names""",
    "usage_fold_stream": lifecycle.ORACLES["usage_fold"],
}
