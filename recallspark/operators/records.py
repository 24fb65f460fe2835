"""Batch changes to records and everything that follows from them.

Each function takes tables and returns the tables as they are afterwards; a
writer publishes them together (see ``sources/snapshots.py``). Slugs name records
within a project, ids identify them everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.operators import bodies
from recallspark.operators.dedup import keep_then_new
from recallspark.operators.usage import RECORD, REPLICA, add_counters
from recallspark.operators.validate import document_errors
from recallspark.session import settle
from recallspark.schema import DOCUMENT, LABEL_PATTERN, RELATED, RecallError

MIRROR = {"related": "related", "supersedes": "superseded_by", "superseded_by": "supersedes"}


def body(df: DataFrame) -> Column:
    """A record's document as JSON text."""
    return F.to_json(F.struct(*[c for c in df.columns if c in DOCUMENT_FIELDS]))


DOCUMENT_FIELDS = (
    "schema_version", "id", "status", "description", "tags", "labels", "scope", "triggers", "remembered_facts",
    "solution_pattern", "pitfalls", "evidence", "relationships",
)


def create(records: DataFrame, incoming: DataFrame, known_labels: list[str], now: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` of a batch of documents.

    ``incoming`` has ``project_id``, the document fields, and optionally
    ``visibility`` and ``memory_id``. Two documents of one batch with the same
    name: the one whose text sorts first is taken.
    """
    rows = incoming
    if "visibility" not in rows.columns:
        rows = rows.withColumn("visibility", F.lit(None).cast("string"))
    if "memory_id" not in rows.columns:
        rows = rows.withColumn("memory_id", F.lit(None).cast("string"))
    created = F.coalesce(F.nullif(F.col("evidence.created"), F.lit("")), F.lit(now))
    rows = rows.withColumn("evidence", F.col("evidence").withField("created", created))
    taken = records.select("project_id", F.col("id"), F.lit(True).alias("_taken")).distinct()
    errors = document_errors(known_labels)
    judged = rows.withColumn("_json", body(rows)).join(taken, ["project_id", "id"], "left").withColumn(
        "errors", F.concat(
            errors, F.when(F.col("_taken"), F.array(F.lit("Memory already exists."))).otherwise(
                F.array().cast("array<string>"))))
    good = judged.where(F.size("errors") == 0)
    firsts = good.groupBy("project_id", "id").agg(F.min("_json").alias("_json"))
    accepted = good.join(firsts, ["project_id", "id", "_json"], "left_semi").dropDuplicates(["project_id", "id"])
    accepted = (
        accepted.withColumn("memory_id", F.coalesce("memory_id", F.md5(F.concat_ws("/", "project_id", "id", F.lit(now)))))
        .withColumn("visibility", F.coalesce("visibility", F.lit("private")))
        .withColumn("tier", F.lit(1)).withColumn("tier_since", F.lit(now))
        .withColumn("archived_at", F.lit(None).cast("string"))
        .withColumn("merged_into", F.lit(None).cast("string"))
        .drop("_json", "_taken", "errors")
    )
    return accepted, judged.where(F.size("errors") > 0).select("project_id", "id", "errors")


def read_bodies(incoming: DataFrame, known_labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(documents, refused)`` of ``project_id, body``: JSON texts that pass every rule, as document columns.

    A refused document goes by the ``id`` it gives, whatever that is; null if it gives none.
    """
    judged = settle(bodies.judged(incoming.select("project_id", "body"), "body", known_labels))
    fine = judged.where(F.size("errors") == 0).select("project_id", F.from_json("body", DOCUMENT).alias("d")).select("project_id", "d.*")
    return fine, judged.where(F.size("errors") > 0).select("project_id", F.get_json_object("body", "$.id").alias("id"), "errors")


def patched(df: DataFrame, patch: str = "patch") -> DataFrame:
    """Deep-merge a JSON patch column into the document columns, see :func:`operators.bodies.merged`.

    Objects merge field by field; lists and scalars replace. A field absent from
    the patch is kept, one present as null becomes null.
    """
    return _as_columns(df.withColumn("_body", bodies.merged(body(df), F.col(patch)))).drop("_body")


def _as_columns(df: DataFrame) -> DataFrame:
    """The document columns read anew from the JSON text in ``_body``."""
    read = df.withColumn("_read", F.from_json("_body", DOCUMENT))
    return read.withColumns({c: F.col(f"_read.{c}") for c in DOCUMENT_FIELDS if c in df.columns}).drop("_read")


def update(
    records: DataFrame, patches: DataFrame, known_labels: list[str], now: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, revisions, refused)`` after applying ``(project_id, id, patch)``.

    The merged document is judged as JSON: wrong types and unknown fields of a patch refuse it.
    """
    before = records.join(patches.select("project_id", "id", "patch"), ["project_id", "id"])
    moved = F.get_json_object("patch", "$.id")
    written = before.withColumn("_name", F.col("id")).withColumn("_body", bodies.merged(body(records), F.col("patch")))
    judged = bodies.judged(written, "_body", known_labels).withColumn("errors", F.concat("errors", F.when(
        moved.isNotNull() & (moved != F.col("_name")), F.array(F.lit("update cannot change an id."))).otherwise(
        F.array().cast("array<string>"))))
    judged = settle(_as_columns(judged).drop("_body"))
    fine = judged.where(F.size("errors") == 0).drop("errors", "patch", "_name")
    # An id is kept when a record moves on to another project, so it names a record only within one.
    revisions = before.join(fine.select(*RECORD), RECORD, "left_semi").select(
        "project_id", "memory_id", F.lit(now).alias("revised_at"), body(records).alias("body"))
    rest = records.join(fine.select(*RECORD), RECORD, "left_anti")
    return (
        rest.unionByName(fine.select(*records.columns)),
        revisions,
        judged.where(F.size("errors") > 0).select("project_id", F.col("_name").alias("id"), "errors"),
    )


def authored_links(records: DataFrame) -> DataFrame:
    """Links as the bodies name them: ``(project_id, src, dst, kind, reason)`` by slug."""
    base = ["project_id", F.col("id").alias("src")]
    related = records.select(*base, F.inline("relationships.related")).select(
        "project_id", "src", F.col("id").alias("dst"), F.lit("related").alias("kind"), "reason")
    out = related
    for kind in ("supersedes", "superseded_by"):
        out = out.unionByName(records.select(*base, F.explode(f"relationships.{kind}").alias("dst")).select(
            "project_id", "src", "dst", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("reason")))
    return out


def with_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """Write links back into the bodies. A record's own link list is part of its document."""
    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("dst"))))

    grouped = links.groupBy("project_id", F.col("src").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(
            F.col("kind") == "related", F.struct(F.col("dst").alias("id"), "reason")))).alias("_related"),
        listed("supersedes").alias("_supersedes"), listed("superseded_by").alias("_superseded_by"))
    empty = F.array().cast("array<string>")
    joined = records.join(grouped, ["project_id", "id"], "left")
    return joined.withColumn("relationships", F.struct(
        F.coalesce("_related", F.array().cast(RELATED)).alias("related"),
        F.coalesce("_supersedes", empty).alias("supersedes"),
        F.coalesce("_superseded_by", empty).alias("superseded_by"),
    )).select(*records.columns)


def spread_links(after: DataFrame, before: DataFrame, written: DataFrame) -> DataFrame:
    """``after`` with the links of the ``written`` records carried to their targets, see :func:`linked_rows`."""
    changed = settle(linked_rows(after, before, written))
    return after.join(changed.select("project_id", "id"), ["project_id", "id"], "left_anti").select(*after.columns).unionByName(changed)


def linked_rows(after: DataFrame, before: DataFrame, written: DataFrame) -> DataFrame:
    """The rows of ``after`` that links of the ``written`` records (``project_id, id``) name or named, as they become.

    What a written record says of a link holds: a target gets the counterpart with the
    writer's reason, and loses it when the writer dropped the link. A written record keeps
    its own list and gains what others written with it say. Lists keep their order and new
    entries follow by name; records that no written one links or linked stay as they are.
    """
    names = written.select("project_id", "id").distinct()
    said = authored_links(after.join(names, ["project_id", "id"], "left_semi"))
    had = authored_links(before.join(names, ["project_id", "id"], "left_semi"))
    flip = F.create_map(*[F.lit(x) for pair in MIRROR.items() for x in pair])
    told = said.select("project_id", F.col("dst").alias("id"), F.col("src").alias("other"), flip[F.col("kind")].alias("kind"), "reason")
    told = told.groupBy("project_id", "id", "other", "kind").agg(F.min("reason").alias("_reason")).withColumn("_told", F.lit(True))
    told = settle(told)
    near = told.select("project_id", "id").union(had.select("project_id", F.col("dst").alias("id"))).distinct()
    near = settle(near)
    rows = after.join(near, ["project_id", "id"], "left_semi")
    at = ["project_id", "id"]
    related = rows.select(*at, F.posexplode("relationships.related").alias("pos", "l")).select(
        *at, F.lit("related").alias("kind"), "pos", F.col("l.id").alias("other"), F.col("l.reason").alias("reason"))
    has = related
    for kind in ("supersedes", "superseded_by"):
        has = has.unionByName(rows.select(*at, F.lit(kind).alias("kind"), F.posexplode(f"relationships.{kind}").alias("pos", "other"),
                                          F.lit(None).cast("string").alias("reason")))
    own = names.withColumn("_own", F.lit(True))
    others = names.select("project_id", F.col("id").alias("other"), F.lit(True).alias("_by_writer"))
    joined = (has.join(told, [*at, "other", "kind"], "full").join(own, at, "left").join(others, ["project_id", "other"], "left"))
    mine = F.coalesce("_own", F.lit(False))
    stays = F.col("pos").isNull() | mine | F.col("_by_writer").isNull() | F.col("_told")
    reason = F.when(F.col("pos").isNotNull() & (mine | F.col("_told").isNull()), F.col("reason")).otherwise(F.col("_reason"))
    entry = F.struct(F.coalesce("pos", F.lit(1 << 30)).alias("pos"), F.col("other"), reason.alias("reason"))
    kept = joined.where(F.coalesce(stays, F.lit(False)))

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))

    grouped = kept.groupBy(*at).agg(*(listed(k).alias(f"_{k}") for k in MIRROR))
    none = "array<struct<pos:int,other:string,reason:string>>"
    of = lambda kind: F.coalesce(F.col(f"_{kind}"), F.array().cast(none))
    return rows.join(grouped, at, "left").withColumn("relationships", F.struct(
        F.transform(of("related"), lambda e: F.struct(e["other"].alias("id"), e["reason"].alias("reason"))).alias("related"),
        F.transform(of("supersedes"), lambda e: e["other"]).alias("supersedes"),
        F.transform(of("superseded_by"), lambda e: e["other"]).alias("superseded_by"))).select(*after.columns)


def unknown_targets(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """``project_id, id, errors`` of documents with a link to what neither the store nor their batch holds."""
    known = records.select("project_id", F.col("id").alias("dst")).union(incoming.select("project_id", "id")).distinct()
    lost = authored_links(incoming).join(known, ["project_id", "dst"], "left_anti")
    return lost.groupBy("project_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_set(
        F.concat(F.lit("linked record '"), "dst", F.lit("' does not exist.")))).alias("errors"))


def edges_of(records: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Authored edges by id, of all records or of the ``written`` rows; a link to a record that does not exist makes no edge."""
    ids = records.select("project_id", F.col("id").alias("src"), F.col("memory_id").alias("_src"))
    targets = ids.withColumnRenamed("src", "dst").withColumnRenamed("_src", "_dst")
    return authored_links(records if written is None else written).join(ids, ["project_id", "src"]).join(targets, ["project_id", "dst"]).groupBy(
        "project_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "kind").agg(F.min("reason").alias("reason"))


def delete(
    doomed: DataFrame, records: DataFrame, edges: DataFrame, usage: DataFrame, outbox: DataFrame, now: str
) -> dict[str, DataFrame]:
    """Remove records everywhere: ``doomed`` is ``(project_id, id, confirm)``, equal or refused.

    Returns the tables left, the ``revisions`` written, the records ``cleaned`` of
    references and the promotions ``cancelled``.
    """
    sure = doomed.where(F.col("id") == F.col("confirm")).select("project_id", "id")
    gone = records.join(sure, ["project_id", "id"], "left_semi")
    ids = gone.select("project_id", "memory_id")
    left = records.join(ids, RECORD, "left_anti")
    lost = gone.select("project_id", F.col("id").alias("dst"))
    links = authored_links(left)
    kept = links.join(lost, ["project_id", "dst"], "left_anti")
    touched = links.join(lost, ["project_id", "dst"], "left_semi").select(
        "project_id", F.col("src").alias("id")).distinct()
    clean = left.join(touched, ["project_id", "id"], "left_anti").unionByName(
        with_links(left.join(touched, ["project_id", "id"], "left_semi"), kept))
    no_src = ids.withColumnRenamed("memory_id", "src")
    no_dst = ids.withColumnRenamed("memory_id", "dst")
    return {
        "records": clean,
        "edges": edges.join(no_src, ["project_id", "src"], "left_anti").join(no_dst, ["project_id", "dst"], "left_anti"),
        "usage": usage.join(ids, RECORD, "left_anti"),
        "outbox": outbox.join(ids, RECORD, "left_anti"),
        "revisions": gone.select("project_id", "memory_id", F.lit(now).alias("revised_at"), body(gone).alias("body")),
        "cleaned": touched,
        "cancelled": outbox.join(ids, RECORD, "left_semi"),
    }


def merge_usage(usage: DataFrame, pairs: DataFrame, keep_window: bool = True) -> DataFrame:
    """Fold counters of merged records into the kept ones: ``pairs`` is ``(project_id, keep, merge)``.

    Counters add. Where the kept record already has a row for a replica, its
    window and last-seen stamps stay as they are unless ``keep_window`` is off,
    in which case both sides' days and stamps count.
    """
    into = pairs.select("project_id", F.col("merge").alias("memory_id"), "keep")
    extra = usage.join(into, RECORD).withColumn("memory_id", F.col("keep")).select(*usage.columns)
    if not keep_window:
        return add_counters(usage, extra)
    rows = usage.withColumn("_own", F.lit(True)).unionByName(extra.withColumn("_own", F.lit(False)))
    best = F.max_by(F.struct("last_surfaced", "last_applied", "spread_bits", "spread_epoch"),
                    F.struct("_own", "spread_epoch", "spread_bits"))
    return rows.groupBy(*REPLICA).agg(
        F.sum("surfaced").alias("surfaced"), F.sum("surfaced_direct").alias("surfaced_direct"),
        F.sum("applied").alias("applied"), best.alias("b")
    ).select(*REPLICA, "surfaced", "surfaced_direct", "applied", "b.*")


def merge(
    records: DataFrame, usage: DataFrame, pairs: DataFrame, now: str, keep_window: bool = True
) -> dict[str, DataFrame]:
    """Fold one record into another: ``pairs`` is ``(project_id, keep_id, merge_id, reason)`` by slug.

    A record is kept or merged once per batch. Lists grow by what they lack,
    counters add, and the merged record is archived with a pointer.
    """
    asked = pairs.where((F.col("keep_id") != F.col("merge_id")) & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    ids = records.select("project_id", "id", "memory_id")
    named = asked.join(ids.select("project_id", F.col("id").alias("keep_id"), F.col("memory_id").alias("keep")),
                       ["project_id", "keep_id"]).join(
        ids.select("project_id", F.col("id").alias("merge_id"), F.col("memory_id").alias("merge")),
        ["project_id", "merge_id"])
    other = records.select("project_id", F.col("memory_id").alias("merge"), *[
        F.col(c).alias(f"m_{c}") for c in
        ("tags", "labels", "triggers", "remembered_facts", "solution_pattern", "pitfalls", "scope", "relationships")])
    kept = records.join(
        named.select("project_id", F.col("keep").alias("memory_id"), "merge", "merge_id"), RECORD
    ).join(other, ["project_id", "merge"])
    lists = ("tags", "labels", "triggers", "remembered_facts", "solution_pattern", "pitfalls")
    known = F.concat(F.transform("relationships.related", lambda r: r["id"]), F.array("id", "merge_id"))
    grown = kept.withColumns({
        **{c: keep_then_new(F.col(c), F.col(f"m_{c}")) for c in lists},
        "scope": F.col("scope").withField("files", keep_then_new(F.col("scope.files"), F.col("m_scope.files")))
        .withField("applies_to", keep_then_new(F.col("scope.applies_to"), F.col("m_scope.applies_to"))),
        "relationships": F.col("relationships").withField("related", F.concat(
            "relationships.related",
            F.filter("m_relationships.related", lambda r: ~F.array_contains(known, r["id"])))),
    }).select(*records.columns)
    pointers = named.select("project_id", F.col("merge").alias("memory_id"), F.col("keep").alias("_into"))
    rest = records.join(grown.select(*RECORD), RECORD, "left_anti").join(pointers, RECORD, "left")
    rest = rest.withColumn("archived_at", F.when(F.col("_into").isNotNull(), F.lit(now)).otherwise(F.col("archived_at")))
    rest = rest.withColumn("merged_into", F.coalesce("_into", "merged_into")).select(*records.columns)
    gone = records.join(pointers, RECORD, "left_semi")
    return {
        "records": rest.unionByName(grown),
        "usage": merge_usage(usage, named.select("project_id", "keep", "merge"), keep_window),
        "revisions": gone.select("project_id", "memory_id", F.lit(now).alias("revised_at"), body(gone).alias("body")),
    }


def _flag(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("project_id", "memory_id", F.lit(True).alias("_hit")).distinct(), RECORD, "left")


def set_archived(records: DataFrame, ids: DataFrame, now: str | None) -> DataFrame:
    """Archive the given records, or restore them when ``now`` is None."""
    value = F.lit(now).cast("string")
    return _flag(records, ids).withColumn(
        "archived_at", F.when(F.col("_hit"), value).otherwise(F.col("archived_at"))).drop("_hit")


def set_visibility(records: DataFrame, ids: DataFrame, visibility: str) -> DataFrame:
    if visibility not in ("private", "public"):
        raise RecallError("visibility must be 'private' or 'public'.")
    return _flag(records, ids).withColumn(
        "visibility", F.when(F.col("_hit"), visibility).otherwise(F.col("visibility"))).drop("_hit")


def apply_audit(records: DataFrame, findings: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """``(records, to_delete)``: promotions restart the clocks, archives take effect."""
    verdicts = findings.where(F.col("verdict") != "hold").select("project_id", "memory_id", "verdict", "queries")
    rows = records.join(verdicts, RECORD, "left")
    up = F.coalesce(F.col("verdict") == "promote", F.lit(False))
    out = F.coalesce(F.col("verdict") == "archive", F.lit(False))
    changed = rows.withColumns({
        "tier": F.when(up, F.col("tier") + 1).otherwise(F.col("tier")),
        "tier_since": F.when(up, F.lit(now)).otherwise(F.col("tier_since")),
        "tier_since_query": F.when(up, F.col("queries")).otherwise(F.col("tier_since_query")),
        "archived_at": F.when(out, F.lit(now)).otherwise(F.col("archived_at")),
    }).select(*records.columns)
    return changed, verdicts.where(F.col("verdict") == "delete").select("project_id", "memory_id")


def add_labels(registry: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(registry, refused)`` after registering ``(project_id, label, description)``."""
    rows = incoming.select("project_id", F.lower(F.trim("label")).alias("label"), F.trim("description").alias("description"))
    have = registry.select("project_id", "label", F.lit(True).alias("_have")).distinct()
    rows = rows.join(have, ["project_id", "label"], "left").withColumn(
        "error",
        F.when(~F.coalesce(F.col("label").rlike(LABEL_PATTERN), F.lit(False)), "Label must use prefix:kebab-case format.")
        .when(F.coalesce("description", F.lit("")) == "", "Label description is required.")
        .when(F.col("_have"), "Label already exists."))
    new = rows.where(F.col("error").isNull()).groupBy("project_id", "label").agg(F.min("description").alias("description"))
    return registry.unionByName(new), rows.where(F.col("error").isNotNull()).select("project_id", "label", "error")


def remove_project(tables: dict[str, DataFrame], project: str, keep: tuple[str, ...] = ("messages",)) -> dict[str, DataFrame]:
    """Drop a project's rows from every table but ``keep``; mail outlives its project."""
    return {
        name: df if name in keep or "project_id" not in df.columns else df.where(F.col("project_id") != project)
        for name, df in tables.items()
    }
