"""Registered queries: usage counters and the retention audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.operators import audit, usage
from recallspark.sources import testdata as src
from recallspark.suite.ctes import sql

NOW = "2021-06-01T00:00:00Z"
DELETING = audit.Policy(delete_superseded=True, min_surfaced_direct=60, min_applied=60, min_spread_days=64,
                        min_degree=40)


def usage_fold(spark: SparkSession, sf: str) -> DataFrame:
    return usage.fold(src.usage_events(spark, sf)).withColumn(
        "spread_days", F.bit_count("spread_bits").cast("long")).drop("spread_bits")


def usage_merged(spark: SparkSession, sf: str) -> DataFrame:
    merged = usage.by_slug(usage.fold(src.usage_events(spark, sf)), src.memories(spark, sf))
    return merged.drop("spread_bits", "memory_id")


def spread_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Active days in the window before each part's newest shipment."""
    l = src.table(spark, sf, "lineitem").select(
        F.lit("shop").alias("project_id"), F.col("l_partkey").cast("string").alias("memory_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("replica_id"),
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("long") + 719163).alias("day"),
        F.lit(1).cast("long").alias("surfaced"), (F.col("l_returnflag") == "A").cast("long").alias("direct"),
        (F.col("l_returnflag") == "R").cast("long").alias("applied"),
        F.col("l_shipdate").cast("date").cast("string").alias("ts"))
    merged = usage.combine(usage.fold(l))
    return merged.select("memory_id", "surfaced", "surfaced_direct", "applied", "spread_epoch", "spread_days",
                         "last_surfaced", "last_applied")


def surfaced_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Records shown often and never applied, most shown first."""
    merged = usage.by_slug(usage.fold(src.usage_events(spark, sf)), src.memories(spark, sf))
    return merged.where((F.col("surfaced") > 0) & (F.col("applied") * 2 < F.col("surfaced_direct"))).select(
        "slug", "surfaced", "surfaced_direct", "applied")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    events = src.usage_events(spark, sf)
    return src.memories(spark, sf), usage.fold(events), src.authored_edges(spark, sf), src.projects(spark, sf)


def _found(spark: SparkSession, sf: str, policy: audit.Policy) -> DataFrame:
    return audit.findings(*_inputs(spark, sf), NOW, policy)


COLUMNS = ["project_id", "slug", "tier", "exposure_queries", "days_in_tier", "surfaced", "surfaced_direct",
           "applied", "spread_days", "degree", "verdict", "reason"]


def audit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, audit.Policy()).select(*COLUMNS)


def audit_deleting(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, DELETING).select(*COLUMNS)


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.summary(_found(spark, sf, audit.Policy()))


def live_successor(spark: SparkSession, sf: str) -> DataFrame:
    return audit.live_successor(src.memories(spark, sf), src.authored_edges(spark, sf))


def in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return audit.authored_in_degree(src.authored_edges(spark, sf))


QUERIES = {
    "usage_fold": usage_fold,
    "usage_merge_replicas": usage_merged,
    "spread_days": spread_by_user,
    "surfaced_applied_gap": surfaced_gap,
    "audit_verdicts": audit_verdicts,
    "audit_delete_superseded": audit_deleting,
    "audit_summary": audit_summary,
    "live_successor": live_successor,
    "in_degree_authored": in_degree,
}


def _fold(keys: str, events: str) -> str:
    touched = f"SELECT *, max(day) OVER (PARTITION BY {keys}) AS newest FROM {events} WHERE surfaced + direct + applied > 0"
    return f"""SELECT {keys}, sum(surfaced)::BIGINT AS surfaced, sum(direct)::BIGINT AS surfaced_direct,
  sum(applied)::BIGINT AS applied, max(CASE WHEN surfaced > 0 THEN ts END) AS last_surfaced,
  max(CASE WHEN applied > 0 THEN ts END) AS last_applied, max(day) AS spread_epoch,
  count(DISTINCT CASE WHEN newest - day < 64 THEN day END) AS spread_days FROM ({touched}) GROUP BY {keys}"""


def _verdicts(delete: bool, direct: int, applied: int, spread: int, degree: int) -> str:
    """The decision list and the cap, restated as one CASE and one row number."""
    gate = ("CASE tier WHEN 1 THEN {0} WHEN 2 THEN {1} WHEN 3 THEN {2} END")
    q, d = gate.format(50, 500, 600), gate.format(30, 180, 365)
    drop = ("WHEN live_successor IS NOT NULL THEN 'delete|superseded by ''' || live_successor || ''', which is still active'"
            if delete else "")
    return f"""
SELECT project_id, slug, tier, exposure_queries, days_in_tier, surfaced, surfaced_direct, applied, spread_days, degree,
  CASE WHEN held THEN 'hold' ELSE v END AS verdict,
  CASE WHEN held THEN 'would ' || v || ', held back by the per-run cap of ' || cap ELSE why END AS reason, held, queries
FROM (
  SELECT *, v IN ('archive', 'delete') AND row_number() OVER (PARTITION BY project_id, v IN ('archive', 'delete')
      ORDER BY CASE WHEN v = 'delete' THEN 0 ELSE 1 END, surfaced, degree, slug) > cap AS held
  FROM (SELECT *, split_part(both_parts, '|', 1) AS v, split_part(both_parts, '|', 2) AS why,
      greatest(1, least(50, CAST(floor(count(*) OVER (PARTITION BY project_id) * 0.1::DOUBLE) AS BIGINT))) AS cap FROM (
    SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'hold|already archived' {drop}
      WHEN {q} IS NULL THEN 'hold|tier ' || tier || ' is past the last gate; not reviewed'
      WHEN exposure_queries < {q} THEN 'hold|only ' || exposure_queries || ' queries of exposure, needs ' || {q}
      WHEN days_in_tier < {d} THEN 'hold|only ' || days_in_tier || ' days in tier ' || tier || ', needs ' || {d}
      WHEN surfaced_direct >= {direct} THEN 'promote|matched a query directly ' || surfaced_direct || 'x'
      WHEN applied >= {applied} THEN 'promote|reported as applied ' || applied || 'x'
      WHEN spread_days >= {spread} THEN 'promote|recalled on ' || spread_days || ' distinct days'
      WHEN degree >= {degree} THEN 'promote|' || degree || ' other memories link to it'
      ELSE 'archive|no direct match, no applied use, no spread, no incoming links after ' || exposure_queries
        || ' queries and ' || days_in_tier || ' days' END AS both_parts FROM audit_evidence)))"""


_SUCCESSOR = """SELECT e.project_id, e.dst AS memory_id, min(m.slug) AS live_successor FROM authored e
  JOIN memories m ON m.project_id = e.project_id AND m.memory_id = e.src
  WHERE e.kind = 'supersedes' AND m.status = 'active' AND m.archived_at IS NULL GROUP BY 1, 2"""
_DEGREE = "SELECT project_id, dst AS memory_id, count(*) AS degree FROM authored GROUP BY 1, 2"
_EXTRA = {
    "merged_usage": (("usage_events",), _fold("project_id, memory_id", "usage_events")),
    "audit_evidence": (("memories", "authored", "projects", "merged_usage"), f"""
SELECT m.*, coalesce(p.queries, 0) AS queries, greatest(0, coalesce(p.queries, 0) - tier_since_query) AS exposure_queries,
  coalesce(greatest(0, floor(date_diff('second', try_strptime(coalesce(tier_since, created), '%Y-%m-%dT%H:%M:%SZ'),
    TIMESTAMP '2021-06-01') / 86400)), 0)::BIGINT AS days_in_tier,
  coalesce(u.surfaced, 0) AS surfaced, coalesce(u.surfaced_direct, 0) AS surfaced_direct,
  coalesce(u.applied, 0) AS applied, coalesce(u.spread_days, 0) AS spread_days, coalesce(g.degree, 0) AS degree, s.live_successor
FROM memories m LEFT JOIN projects p USING (project_id) LEFT JOIN merged_usage u USING (project_id, memory_id)
LEFT JOIN ({_DEGREE}) g USING (project_id, memory_id) LEFT JOIN ({_SUCCESSOR}) s USING (project_id, memory_id)"""),
}
_PICK = "SELECT " + ", ".join(COLUMNS)

ORACLES = {
    "usage_fold": sql(_fold("project_id, memory_id, replica_id", "usage_events"), "usage_events"),
    "usage_merge_replicas": sql("""
SELECT u.project_id, m.slug, surfaced, surfaced_direct, applied, last_surfaced, last_applied, spread_epoch, spread_days
FROM merged_usage u JOIN memories m USING (project_id, memory_id)""", "merged_usage", "memories", extra=_EXTRA),
    "spread_days": "WITH shipped AS (SELECT l_partkey::VARCHAR AS memory_id, 1 AS surfaced, (l_returnflag = 'A')::BIGINT AS direct, "
                   "(l_returnflag = 'R')::BIGINT AS applied, strftime(l_shipdate, '%Y-%m-%d') AS ts, "
                   "date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + 719163 AS day FROM lineitem) "
                   + _fold("memory_id", "shipped"),
    "surfaced_applied_gap": sql("""
SELECT m.slug, surfaced, surfaced_direct, applied FROM merged_usage u JOIN memories m USING (project_id, memory_id)
WHERE surfaced > 0 AND applied * 2 < surfaced_direct""", "merged_usage", "memories", extra=_EXTRA),
    "audit_verdicts": sql(f"{_PICK} FROM ({_verdicts(False, 1, 1, 2, 2)})", "audit_evidence", extra=_EXTRA),
    "audit_delete_superseded": sql(f"{_PICK} FROM ({_verdicts(True, 60, 60, 64, 40)})", "audit_evidence", extra=_EXTRA),
    "audit_summary": sql(f"""
SELECT project_id, max(queries) AS queries, count(*) AS examined, count(*) FILTER (verdict <> 'hold') AS due,
  count(*) FILTER (verdict = 'promote') AS promoted, count(*) FILTER (verdict = 'archive') AS archived,
  count(*) FILTER (verdict = 'delete') AS deleted, count(*) FILTER (held) AS capped
FROM ({_verdicts(False, 1, 1, 2, 2)}) GROUP BY 1""", "audit_evidence", extra=_EXTRA),
    "live_successor": sql(_SUCCESSOR, "authored", "memories"),
    "in_degree_authored": sql(_DEGREE, "authored"),
}
