"""Retention audit: one decision list over every record of every project at once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.functions.rank import top_k
from recallspark.functions.stamps import age_days
from recallspark.operators.usage import combine
from recallspark.schema import RecallError
from recallspark.session import settle


@dataclass(frozen=True)
class Gate:
    """What a record of one tier must have lived through before it is judged."""

    tier: int
    min_queries: int
    min_days: int


@dataclass(frozen=True)
class Policy:
    # ----------------------------------------------------------- fixed values
    gates: tuple[Gate, ...] = (Gate(1, 50, 30), Gate(2, 500, 180), Gate(3, 600, 365))
    min_surfaced_direct: int = 1
    min_applied: int = 1
    min_spread_days: int = 2
    min_degree: int = 2
    max_actions_per_run: int = 50
    max_action_fraction: float = 0.1
    delete_superseded: bool = False
    # ------------------------------------------------------- end fixed values

    def describe(self) -> str:
        return json.dumps(asdict(self))

    def cap(self, size: Column) -> Column:
        share = F.floor(size.cast("double") * self.max_action_fraction).cast("long")
        return F.greatest(F.lit(1), F.least(F.lit(self.max_actions_per_run), share)).cast("long")

    def with_overrides(self, **changes: object) -> Policy:
        """Replace the settings that are given; None leaves one alone."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def gates_from(specs: list[str] | None, base: tuple[Gate, ...] = Policy.gates) -> tuple[Gate, ...]:
    """``tier:queries:days`` strings laid over ``base`` one tier at a time."""
    table = {gate.tier: gate for gate in base}
    for spec in specs or []:
        numbers = spec.split(":")
        if len(numbers) != 3 or not all(n.strip().lstrip("+-").isdigit() for n in numbers):
            raise RecallError(f"a gate is tier:queries:days in whole numbers, got '{spec}'")
        gate = Gate(*map(int, numbers))
        if gate.tier < 1 or gate.min_queries < 0 or gate.min_days < 0:
            raise RecallError(f"a gate needs tier >= 1 and no negative numbers: '{spec}'")
        table[gate.tier] = gate
    return tuple(table[tier] for tier in sorted(table))


def live_successor(records: DataFrame, edges: DataFrame) -> DataFrame:
    """``(project_id, memory_id, live_successor)``: replaced records whose successor still stands."""
    standing = records.where((F.col("status") == "active") & F.col("archived_at").isNull())
    return (
        edges.where(F.col("kind") == "supersedes")
        .join(standing.select("project_id", F.col("memory_id").alias("src"), "slug"), ["project_id", "src"])
        .groupBy("project_id", F.col("dst").alias("memory_id"))
        .agg(F.min("slug").alias("live_successor"))
    )


def authored_in_degree(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("kind") != "derived")
        .groupBy("project_id", F.col("dst").alias("memory_id"))
        .agg(F.count("*").alias("degree"))
    )


def evidence(records: DataFrame, usage: DataFrame, edges: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    """Every record with its clocks, merged counters, authored degree and successor.

    All three side tables are pre-aggregated to one row per record, so no key
    repeats on either side of a join.
    """
    key = ["project_id", "memory_id"]
    counters = combine(usage).select(*key, "surfaced", "surfaced_direct", "applied", "spread_days")
    base = records.select(
        *key, "slug", "status", "tier", "tier_since_query", "archived_at",
        age_days(F.coalesce(F.nullif("tier_since", F.lit("")), "created"), now).alias("days_in_tier"))
    return (
        base.join(counters, key, "left")
        .join(authored_in_degree(edges), key, "left")
        .join(live_successor(records, edges), key, "left")
        .join(projects.select("project_id", "queries"), "project_id", "left")
        .na.fill(0, ["surfaced", "surfaced_direct", "applied", "spread_days", "degree", "queries"])
        .withColumn(
            "exposure_queries",
            F.greatest(F.lit(0), F.col("queries") - F.col("tier_since_query")).cast("long"))
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def judge(found: DataFrame, policy: Policy) -> DataFrame:
    """Add ``verdict`` and ``reason`` by the first rule that applies."""
    c = F.col
    tier = c("tier")
    queries = days = F.lit(None).cast("long")
    for gate in policy.gates:
        queries = F.when(tier == gate.tier, F.lit(gate.min_queries).cast("long")).otherwise(queries)
        days = F.when(tier == gate.tier, F.lit(gate.min_days).cast("long")).otherwise(days)
    rules: list[tuple[Column, str, Column]] = [(c("archived_at").isNotNull(), "hold", F.lit("already archived"))]
    if policy.delete_superseded:
        rules.append((
            c("live_successor").isNotNull(), "delete",
            _text("superseded by '", c("live_successor"), "', which is still active")))
    rules += [
        (queries.isNull(), "hold", _text("tier ", tier, " is past the last gate; not reviewed")),
        (c("exposure_queries") < queries, "hold",
         _text("only ", c("exposure_queries"), " queries of exposure, needs ", queries)),
        (c("days_in_tier") < days, "hold",
         _text("only ", c("days_in_tier"), " days in tier ", tier, ", needs ", days)),
        (c("surfaced_direct") >= policy.min_surfaced_direct, "promote",
         _text("matched a query directly ", c("surfaced_direct"), "x")),
        (c("applied") >= policy.min_applied, "promote", _text("reported as applied ", c("applied"), "x")),
        (c("spread_days") >= policy.min_spread_days, "promote",
         _text("recalled on ", c("spread_days"), " distinct days")),
        (c("degree") >= policy.min_degree, "promote", _text(c("degree"), " other memories link to it")),
    ]
    verdict, reason = F.lit("archive"), _text(
        "no direct match, no applied use, no spread, no incoming links after ",
        c("exposure_queries"), " queries and ", c("days_in_tier"), " days")
    for holds, name, why in reversed(rules):
        verdict = F.when(holds, F.lit(name)).otherwise(verdict)
        reason = F.when(holds, why).otherwise(reason)
    return found.select("*", verdict.alias("verdict"), reason.alias("reason"))


def hold_back(judged: DataFrame, policy: Policy) -> DataFrame:
    """Turn removals past each project's cap into holds, the weakest records going first.

    The cap never exceeds ``max_actions_per_run``, so only that many removals per
    project are ever ranked in one task; the rest are held by not being among them.
    """
    key = ["project_id", "memory_id"]
    caps = judged.groupBy("project_id").agg(policy.cap(F.count("*")).alias("cap"))
    removal = F.col("verdict").isin("archive", "delete")
    first = top_k(
        judged.where(removal).select(*key, "verdict", "surfaced", "degree", "slug"),
        ["project_id"],
        [(F.col("verdict") != "delete").asc(), F.col("surfaced"), F.col("degree"), F.col("slug")],
        max(1, policy.max_actions_per_run), spread_on="memory_id")
    allowed = first.join(caps, "project_id").where(F.col("rn") <= F.col("cap")).select(
        *key, F.lit(True).alias("_allowed"))
    held = removal & F.col("_allowed").isNull()
    return (
        judged.join(caps, "project_id").join(allowed, key, "left")
        .withColumn("reason", F.when(
            held, _text("would ", F.col("verdict"), ", held back by the per-run cap of ", F.col("cap"))
        ).otherwise(F.col("reason")))
        .withColumn("capped", held)
        .withColumn("verdict", F.when(held, "hold").otherwise(F.col("verdict")))
        .drop("_allowed")
    )


def findings(
    records: DataFrame, usage: DataFrame, edges: DataFrame, projects: DataFrame, now: str,
    policy: Policy = Policy(),
) -> DataFrame:
    # Counted, ranked and joined below: written once rather than judged three times.
    return hold_back(settle(judge(evidence(records, usage, edges, projects, now), policy)), policy)


def summary(found: DataFrame) -> DataFrame:
    """Verdict counts per project."""
    def n(condition: Column) -> Column:
        return F.count_if(condition)

    v = F.col("verdict")
    return found.groupBy("project_id").agg(
        F.max("queries").alias("queries"),
        F.count("*").alias("examined"),
        n(v != "hold").alias("due"),
        n(v == "promote").alias("promoted"),
        n(v == "archive").alias("archived"),
        n(v == "delete").alias("deleted"),
        n(F.col("capped")).alias("capped"),
    )


def last_run(runs: DataFrame, found: DataFrame, verdicts: list[str] | None = None) -> DataFrame:
    """Findings of each project's most recent run."""
    latest = runs.groupBy("project_id").agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))
    kept = found if not verdicts else found.where(F.col("verdict").isin(*verdicts))
    return kept.join(latest, ["project_id", "run_id"], "left_semi")


def report(found: DataFrame, project: str, applied: bool = False, limit: int = 20) -> str:
    """Readable summary of one project's findings; at most ``limit`` lines per verdict."""
    row = summary(found.where(F.col("project_id") == project)).head()
    if row is None:
        return f"audit of '{project}': no records"
    lines = [
        f"audit of '{project}' - " + ("changes applied" if applied else "report only, nothing changed"),
        f"  {row['examined']} records, {row['queries']} queries served",
        f"  promote {row['promoted']}, archive {row['archived']}, delete {row['deleted']}, "
        f"held back by the cap {row['capped']}",
    ]
    mine = found.where(F.col("project_id") == project)
    for verdict in ("delete", "archive", "promote"):
        rows = mine.where(F.col("verdict") == verdict).orderBy("slug").limit(limit).collect()
        if rows:
            lines.append(f"{verdict}:")
            lines += [f"  {r['slug']}  ({r['reason']})" for r in rows]
    if row["due"] == 0:
        nearest = mine.orderBy(F.col("exposure_queries").desc(), "slug").limit(1).collect()
        lines += [f"Nothing is due yet. Closest: {r['slug']} - {r['reason']}" for r in nearest]
    return "\n".join(lines)
