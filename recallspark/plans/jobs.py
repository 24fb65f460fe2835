"""Maintenance jobs in priority order, each a function of the store's tables.

Spark parallelises inside a job; the jobs themselves run one after another, a
failing one is logged and does not stop the rest.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.operators import audit, cache, dedup, outbox, records, validate
from recallspark.operators.similar import derived_edges
from recallspark.schema import TABLES
from recallspark.session import settle

# --------------------------------------------------------------- fixed values
PRIORITY = {"outbox": 10, "rebase": 20, "audit": 30, "evict": 35, "reindex": 40, "dedup": 50}
STARTUP_GRACE_SECONDS = 15
MIN_INTERVAL_SECONDS = 60
MAX_DETAIL = 4000
# ----------------------------------------------------------- end fixed values

Tables = dict[str, DataFrame]


def flat(rows: DataFrame) -> DataFrame:
    """Stored documents with ``slug`` and ``files`` where the operators look for them."""
    return rows.withColumn("slug", F.col("id")).withColumn("files", F.col("scope.files")).withColumn(
        "created", F.col("evidence.created"))


def audit_job(tables: Tables, now: str, policy: audit.Policy = audit.Policy(), apply: bool = True) -> tuple[Tables, dict]:
    own = flat(tables["records"])
    found = settle(audit.findings(own, tables["usage"], tables["edges"], tables["projects"], now, policy))
    counts = {r["project_id"]: r.asDict() for r in audit.summary(found).collect()}  # one row per project
    run = F.concat_ws("/", "project_id", F.lit(now))
    out = dict(tables)
    new_runs = audit.summary(found).select(
        run.alias("run_id"), "project_id", F.lit(now).alias("started"), F.lit(now).alias("finished"),
        F.lit(apply).alias("applied"), "queries", "examined", "due", "promoted", "archived", "deleted", "capped",
        F.lit(policy.describe()).alias("policy"))
    evidence = F.to_json(F.struct("exposure_queries", "days_in_tier", "surfaced", "surfaced_direct", "applied",
                                  "spread_days", "degree"))
    new_findings = found.select(run.alias("run_id"), "project_id", "memory_id", "slug", "tier", "verdict", "reason",
                                evidence.alias("evidence"))
    out["audit_runs"] = tables["audit_runs"].unionByName(new_runs)
    out["audit_findings"] = tables["audit_findings"].unionByName(new_findings)
    if apply:
        changed, gone = records.apply_audit(tables["records"], found, now)
        doomed = changed.join(gone, ["project_id", "memory_id"], "left_semi").select(
            "project_id", "id", F.col("id").alias("confirm"))
        left = records.delete(doomed, changed, tables["edges"], tables["usage"], tables["outbox"], now)
        for name in ("records", "edges", "usage", "outbox"):
            out[name] = left[name]
        out["revisions"] = tables["revisions"].unionByName(left["revisions"], allowMissingColumns=True)
    return out, counts


def evict_job(tables: Tables, now: str, **bounds: int) -> tuple[Tables, dict]:
    kept = cache.retained(tables["cached"], now, **bounds)
    return {**tables, "cached": kept}, {"evicted": cache.evicted(tables["cached"], kept).count()}


def reindex_job(tables: Tables, now: str) -> tuple[Tables, dict]:
    fresh = derived_edges(flat(tables["records"])).select(
        "project_id", "src", "dst", F.lit("derived").alias("kind"), F.lit(None).cast("string").alias("reason"))
    authored = tables["edges"].where("kind <> 'derived'")
    return {**tables, "edges": authored.unionByName(fresh)}, {"rebuilt": tables["records"].where("archived_at IS NULL").count()}


def dedup_job(tables: Tables, now: str, threshold: float = 0.6, limit: int = 25) -> tuple[Tables, dict]:
    """The strongest ``limit`` pairs of every project; the detail is one row per project, as a table."""
    pairs = dedup.duplicate_report(
        dedup.duplicate_pairs(flat(tables["records"]), tables["edges"].where("kind = 'derived'"), threshold), limit)
    return tables, dedup_details(tables["records"], pairs)


def dedup_details(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``project_id, detail`` of a duplicate report: how many pairs, and the pairs, strongest first."""
    listed = pairs.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rn", "a", "b"))).alias("best"))
    every = records.select("project_id").distinct().join(listed, "project_id", "left")
    best = F.coalesce("best", F.array().cast("array<struct<rn:int,a:string,b:string>>"))
    return every.select("project_id", F.to_json(F.struct(
        F.size(best).alias("candidates"), F.transform(best, lambda p: F.array(p["a"], p["b"])).alias("pairs"))).alias("detail"))


def rebase_job(tables: Tables, now: str, mark_stale: bool = False) -> tuple[Tables, dict]:
    if "listing" not in tables:
        return tables, {"checked": 0, "skipped": "no file listing for this store"}
    own = flat(tables["records"])
    adrift = validate.anchors_adrift(own, tables["listing"])
    out = tables
    if mark_stale:
        out = {**tables, "records": validate.mark_stale(tables["records"], adrift)}
    return out, {"adrift": adrift.count(), "marked_stale": mark_stale}


def outbox_job(tables: Tables, now: str, run: str | None = None) -> tuple[Tables, dict]:
    """Deliver what waits for reachable remotes. Repeating a run, under its id or another, delivers nothing twice."""
    own = flat(tables["records"])
    sorted_out = settle(outbox.classify(tables["outbox"], own, tables["remotes"], outbox.published_text()))
    bodies = own.select("project_id", "memory_id", outbox.published_text().alias("body"))
    failed, outcome = outbox.deliver(sorted_out, bodies, tables["remotes"], run or now.replace(":", ""), now)
    failed = settle(failed)
    counts = {r["action"]: r["count"] for r in sorted_out.groupBy("action").count().collect()}  # four at most
    lost = failed.count()
    left = outbox.after_delivery(sorted_out, failed).select(*tables["outbox"].columns)
    detail = {"sent": counts.get("send", 0) - lost, "failed": lost, "held": counts.get("hold", 0),
              "dropped": counts.get("drop", 0), "skipped": counts.get("skip", 0)}
    return {**tables, "outbox": left, "remotes": outbox.stamped(tables["remotes"], outcome, now)}, detail


JOBS: dict[str, Callable[..., tuple[Tables, dict]]] = {
    "outbox": outbox_job, "rebase": rebase_job, "audit": audit_job, "evict": evict_job, "reindex": reindex_job, "dedup": dedup_job,
}


def short(detail: dict) -> str:
    """JSON of at most ``MAX_DETAIL`` characters: where it would be longer, its longest texts are cut, never the JSON."""
    text = json.dumps(detail)
    while len(text) > MAX_DETAIL and any(isinstance(v, str) and len(v) > 40 for v in detail.values()):
        longest = max((k for k, v in detail.items() if isinstance(v, str)), key=lambda k: len(detail[k]))
        detail = {**detail, longest: detail[longest][: len(detail[longest]) // 2]}
        text = json.dumps(detail)
    return text


def run(spark: SparkSession, tables: Tables, kinds: list[str], now: str, **options: dict) -> Tables:
    """Run each requested kind once, most urgent first, and append the log to ``jobs``."""
    log, per_project = [], []
    for kind in sorted(set(kinds), key=lambda k: PRIORITY[k]):
        try:
            after, detail = JOBS[kind](tables, now, **options.get(kind, {}))
            # What a job changed is written before the next one reads it.
            tables = {k: df if df is tables.get(k) else settle(df) for k, df in after.items()}
            if isinstance(detail, DataFrame):  # a row per project, lazy: whatever fails in it fails here
                rows = detail.select(F.lit(None).cast("bigint").alias("id"), "project_id", F.lit(kind).alias("kind"), F.lit(now).alias("started"),
                                     F.lit(now).alias("finished"), F.lit("done").alias("outcome"), "detail")
                per_project.append(settle(rows))
                continue
            outcome = "done"
        except Exception as error:  # a failed job must not stop the ones after it
            detail, outcome = {"error": str(error)}, "failed"
        log.append((None, "*", kind, now, now, outcome, short(detail)))
    fresh = spark.createDataFrame(log, TABLES["jobs"])
    for rows in per_project:
        fresh = fresh.unionByName(rows)
    have = tables.get("jobs")
    return {**tables, "jobs": fresh if have is None else have.unionByName(fresh)}


def seconds_since_last_run(jobs: DataFrame, now: str) -> float | None:
    """From the log, not from uptime; None without a record."""
    row = jobs.agg((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(
        F.max("started").try_cast("timestamp"))).alias("gap")).head()
    return None if row["gap"] is None else max(0.0, float(row["gap"]))


def first_delay(since: float | None, interval: int = 3600) -> float:
    """How long a fresh process waits: overdue work soon, never sooner than the grace."""
    interval = max(MIN_INTERVAL_SECONDS, int(interval))
    if since is None:
        return float(min(interval, STARTUP_GRACE_SECONDS))
    return float(max(STARTUP_GRACE_SECONDS, min(interval, interval - since)))
