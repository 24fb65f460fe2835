"""Mixing sources to target weights by systematic sampling.

Each source's target is its weighted share of the mix, at most ``most`` times its size,
the excess going to the others by weight (water filling). All documents of a source have
the same expected number of copies, target over size; with their prefix sums in a source
and one random offset, a document is taken once for every integer the running sum crosses.
The order in a source is by size, so that documents of each length are taken at the
source's rate and the words taken come near the target.

Defined results: null texts have no words; documents without a source are one source, the
last; a source without words has target 0 and nothing is taken from it; repeated rows are
documents of their own; null ids are sampled like others. Only named columns are read, and
all columns of the input stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.ranks import numbered

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, SEED = 1.5, 2.0, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(name: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the name alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    Sources in the order of code points, null last, take the weights in turn. Sources are ordered by
    the size they reach per weight; those that the level exceeds are filled, and the level that
    the rest share follows from running sums. Exact, in one pass over the sources.
    """
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every) * F.lit(share)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # Filled as long as each source's cap is below the level that is left when its turn comes.
    s = s.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    s = s.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Every row's ``_key, _source, size, source_size, target`` and ``copies``; see ``sample`` for whole rows."""
    rows = settle(df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), words(F.col(text)).alias("size")))
    total = rows.count()
    goal = targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.select(F.col("source").alias("_goal"), "source_size", "target")
    name = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    salt = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")
    placed = numbered(rows, ["_source"], ["size"], [F.col("_key").asc_nulls_last()], salt, total)
    placed = placed.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, F.col("_source").eqNullSafe(F.col("_goal")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = uniform(F.coalesce(F.concat(F.lit("s:"), F.col("_source")), F.lit("null")), seed)
    upto = lambda n: F.floor(n * rate + u)
    copies = (upto(F.col("position") + 1) - upto(F.col("position"))).cast("int")
    return placed.select("_key", "_source", "size", "source_size", "target", copies.alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(blocks.read(spark, sf_dir, "documents"))
    return mixed.select(F.col("_key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op6_systematic_mix": query}
ORACLES = {"op6_systematic_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
  [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, (cap / w, source)) AS final FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN f.final IS NULL THEN cap ELSE least(cap, f.final * w) END AS target,
  ('0x' || substr(md5('mix:' || coalesce('s:' || source, 'null')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM l, f),
g AS (SELECT d.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
    % ceil(count(*) OVER (PARTITION BY source, size) * 8192 / greatest(count(*) OVER (), 8192))::BIGINT AS part FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, part, doc_id) - 1 AS position FROM g)
SELECT p.doc_id, p.size, t.source_size, t.target,
  (CASE WHEN t.source_size > 0 THEN floor((position + 1) * (t.target / t.source_size) + u) - floor(position * (t.target / t.source_size) + u) ELSE 0 END)::BIGINT * p.size AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""}
