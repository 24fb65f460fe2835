"""Weighted BM25 over a multi-field text index.

The index of one record is an array of ``(term, weight)`` entries built inside
the scan and cut to the terms somebody asked about *before* anything is shuffled.
Shuffles are by record, so a frequent term never becomes a hot key, and into as many parts
as there is work: what a task sums up does not grow with the table. The only rows that
then cross the network are each task's best ``limit`` records per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallspark.functions.rank import top_k
from recallspark.functions.text import fold_all, query_terms, token_set, tokens
from recallspark.schema import BM25_B, BM25_K1, FIELD_WEIGHTS, IDF_FLOOR, TEXT_LIMIT
from recallspark.session import settle



def text_fields(
    slug: Column,
    description: Column,
    triggers: Column | None = None,
    tags: Column | None = None,
    labels: Column | None = None,
    facts: Column | None = None,
    pattern: Column | None = None,
    pitfalls: Column | None = None,
    scope: list[Column] | None = None,
) -> dict[str, Column]:
    """The indexed fields of a record; those not given index as nothing."""
    given = {
        "id_text": slug, "description": description, "triggers": triggers, "tags": tags, "labels": labels,
        "facts": facts, "pattern": pattern, "pitfalls": pitfalls,
    }
    plain = ("id_text", "description")
    fields = {
        name: F.coalesce(value if name in plain else F.array_join(value, " "), F.lit(""))
        for name, value in given.items() if value is not None
    }
    if scope:
        fields["scope_text"] = F.concat_ws(" ", *scope)
    return fields


def index_rows(records: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per record: ``keep`` columns, ``entries`` and the row length ``dl``.

    Tokens are distinct per field except in ``labels``, which is indexed as
    written; folding comes after, so two spellings of one word still count twice.
    """
    def entries(name: str, text: Column) -> Column:
        found = tokens(text) if name == "labels" else token_set(text)
        weight = F.lit(FIELD_WEIGHTS[name])
        return F.transform(
            fold_all(text, found), lambda t: F.struct(t.alias("term"), weight.alias("w")))

    arrays = [entries(name, text) for name, text in fields.items()]
    return records.select(*keep, F.concat(*arrays).alias("entries")).withColumn(
        "dl", F.size("entries").cast("double")
    )


def summed(index: DataFrame, keep: list[str]) -> DataFrame:
    """Index rows with one entry per term, without moving any: sorted entries are cut where the term changes."""
    rows = index.select(*keep, "dl", F.sort_array("entries").alias("entries"))
    start = F.transform("entries", lambda x, i: F.when((i == 0) | (F.get("entries", i - 1)["term"] != x["term"]), i))
    rows = rows.withColumn("starts", F.filter(start, lambda i: i.isNotNull()))
    def entry(at: Column, i: Column) -> Column:
        run = F.slice("entries", at + 1, F.coalesce(F.get("starts", i + 1), F.size("entries")) - at)
        return F.struct(F.get("entries", at)["term"].alias("term"), F.aggregate(run, F.lit(0.0), lambda a, x: a + x["w"]).alias("f"))
    return rows.select(*keep, "dl", F.transform("starts", entry).alias("entries"))


def explode_queries(queries: DataFrame) -> DataFrame:
    """``(query_id, project_id, term, times)`` from ``query``."""
    return (
        queries.select("query_id", "project_id", F.explode(query_terms(F.col("query"))).alias("term"))
        .groupBy("query_id", "project_id", "term")
        .agg(F.count("*").cast("double").alias("times"))
    )


#: (question term, record) meetings that one task sums up, at about 260 bytes each.
TASK_MEETINGS = 1_000_000
# Question terms are shipped to every task up to this many rows (about 60 bytes each).
BROADCAST_TERMS = 200_000
ITSELF = ""
# A term in more than this share of all records is common.
COMMON_SHARE = 0.1
# Below this many (question term, record) meetings, two passes cost more than they save.
SKIP_ABOVE = 1e8


def wanted_postings(index: DataFrame, asked: DataFrame, keep: list[str], ship=lambda df: df) -> DataFrame:
    """Postings of the asked-for terms only, partitioned by record.

    ``(memory_id, *keep, dl, term, f)`` with ``f`` the summed field weights. Each
    record also brings one row for the empty term, which no text contains: it
    lets collection statistics come from the same pass over the text.
    """
    itself = F.array(F.struct(F.lit(ITSELF).alias("term"), F.lit(0.0).alias("w")))
    asked = asked.unionByName(asked.sparkSession.createDataFrame([(ITSELF,)], "term string"))
    exploded = index.select("memory_id", *keep, "dl", F.inline(F.concat("entries", itself)))
    # Written before it is shuffled, since only its size tells into how many parts.
    hits = settle(exploded.join(ship(asked), "term", "left_semi"))
    return (
        hits.repartition(parts(hits.sparkSession, hits.count()), "memory_id")
        .groupBy("memory_id", *keep, "dl", "term")
        .agg(F.sum("w").alias("f"))
    )


def bm25(
    index: DataFrame,
    queries: DataFrame,
    limit: int = TEXT_LIMIT,
    stats_by: list[str] | None = None,
    partition: list[str] | None = None,
    skip_above: float = SKIP_ABOVE,
) -> DataFrame:
    """Best ``limit`` live records per query (and per ``partition`` value).

    ``index`` comes from :func:`index_rows` with at least ``project_id``,
    ``memory_id``, ``live``. Row count, document frequency and average length
    are taken over the whole index, or separately per ``stats_by`` columns.
    Returns ``query_id, project_id, memory_id, raw, text, rn`` plus those
    columns; ``raw`` is rounded to nine places so ties are ties on any machine.
    Once questions and records would meet in more than ``skip_above`` terms,
    common terms are scored only where they can matter (same result).
    """
    scope = stats_by or []
    apart = partition or []
    keep = list(dict.fromkeys(["project_id", "live", *scope, *apart]))
    terms = explode_queries(queries)
    n_terms = terms.limit(BROADCAST_TERMS + 1).count()
    small = n_terms <= BROADCAST_TERMS
    if not n_terms:
        index = index.where(F.lit(False))  # nothing is asked, so no text needs to be read
    ship = F.broadcast if small else (lambda df: df)
    asked = terms.select("term").distinct()
    # Three readers (statistics, document frequency, scoring) share one pass over the text.
    postings = settle(wanted_postings(index, asked, keep, ship))

    group = scope or [F.lit(0).alias("_all")]
    names = scope or ["_all"]
    stats = postings.where(F.col("term") == ITSELF).groupBy(*group).agg(
        F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy(*group, "term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = settle(
        terms.join(df, ["term", *(c for c in scope if c == "project_id")])
        .join(stats, names)
        .select(
            "query_id", "term", "times", *dict.fromkeys(["project_id", *scope]), "avgdl",
            F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf).alias("idf"),
            (F.col("df") > F.col("n") * COMMON_SHARE).alias("common"), "df",
        ))
    live = postings.where(F.col("live") & (F.col("term") != ITSELF))
    on = list(dict.fromkeys(["term", "project_id", *scope]))
    work = weights.agg(F.sum("df")).head()[0] or 0.0
    if small:
        live = live.repartition(parts(live.sparkSession, work), "memory_id")
    if scope or apart or work <= skip_above:
        scored = _sum(_gains(live, ship(weights), on, apart), apart)
    else:
        scored = _skipping(live, weights, on, limit, ship)
    best = top_k(
        scored, ["query_id", *apart], [F.col("raw").desc(), F.col("memory_id")], limit)
    best = best.join(queries.select("query_id", "project_id"), "query_id")
    top = F.max("raw").over(Window.partitionBy("query_id", *apart))
    return best.withColumn("text", F.greatest(F.lit(0.0), F.col("raw") / F.when(top == 0, 1.0).otherwise(top)))


def parts(spark, work: float) -> int:
    """Tasks for so many meetings: each has a bounded number of them, however many records there are."""
    return max(spark.sparkContext.defaultParallelism, int(work // TASK_MEETINGS) + 1)


def _gains(postings: DataFrame, weights: DataFrame, on: list[str], apart: list[str]) -> DataFrame:
    """What each term adds to each (record, query) pair it occurs in."""
    f = F.col("f")
    norm = BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("dl") / F.col("avgdl"))
    gain = F.col("times") * F.col("idf") * f * (BM25_K1 + 1) / (f + norm)
    return postings.join(weights, on).select("memory_id", "query_id", *apart, gain.alias("gain"))


def _sum(gains: DataFrame, apart: list[str]) -> DataFrame:
    return gains.groupBy("memory_id", "query_id", *apart).agg(F.round(F.sum("gain"), 9).alias("raw"))


def _skipping(live: DataFrame, weights: DataFrame, on: list[str], limit: int, ship) -> DataFrame:
    """Scores of every pair that can still be among a query's best ``limit``.

    A common term meets a large share of all records and adds little to each:
    less than ``(k1 + 1) * idf``. So rare terms are scored first. The score of the
    ``limit``-th best record by rare terms alone is one the final list certainly
    reaches, and a record that stays below it even with everything the common
    terms could add is out. Only the others are joined to common terms. A query
    whose common terms could carry a record into the list on their own, or whose
    rare terms find too few records, is scored in full. The result is exact.
    """
    slack = 1e-6  # far above the rounding of a sum, so ties are never skipped
    rare = _gains(live, ship(weights.where(~F.col("common"))), on, []).groupBy("memory_id", "query_id").agg(
        F.sum("gain").alias("part"))
    sure = top_k(rare, ["query_id"], [F.col("part").desc(), F.col("memory_id")], limit).where(
        F.col("rn") == limit).select("query_id", F.col("part").alias("sure"))
    most = weights.groupBy("query_id").agg(
        F.sum(F.when(F.col("common"), F.col("times") * F.col("idf") * (BM25_K1 + 1)).otherwise(0.0)).alias("most"))
    bounds = settle(sure.join(most, "query_id").where(F.col("sure") > F.col("most") + slack))
    open_pairs = rare.join(ship(bounds), "query_id").where(F.col("part") + F.col("most") >= F.col("sure") - slack)
    first = open_pairs.select("memory_id", "query_id", F.col("part").alias("gain"))
    rest = _gains(
        live.join(first.select("memory_id", "query_id"), "memory_id"),
        ship(weights.where("common")), ["query_id", *on], [])
    whole = _gains(live, ship(weights.join(bounds, "query_id", "left_anti")), on, [])
    # The questions of both are different ones.
    return _sum(first.unionByName(rest), []).unionByName(_sum(whole, []))
