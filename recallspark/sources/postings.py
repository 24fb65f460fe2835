"""A stored text index: blocks of postings with bounds, and exact top lists that skip blocks.

An index is a list of segments under one folder; each segment is a set of Parquet tables that
are laid out by a hash of the term (``bucket``) and sorted by project and term inside, so a
question reads its terms' files and, of those, its project's row groups:

* ``postings``: one row per block, the live records of one project that hold one term with one
  weight and about one length: their numbers, weights and lengths as arrays of about ``BLOCK``.
* ``blocks``: the same rows without the arrays: size, largest weight, least length. They bound
  what the term can add to any record of the block.
* ``terms``: how many records of a project hold a term, live or not.
* ``rows``: each record's number in the segment, its ids, terms and weights. A question reads only
  numbers and ids of it, to name what it found; terms are read by :meth:`Postings.refresh` and
  :meth:`Postings.compact`.
* ``gone``: records, by segment and number, that the segment replaces or removes in those before it.
* ``stats``: records and summed lengths by project.

A refresh writes one segment that holds the changed records only, with the counts that the
replaced ones take back; its size follows the change, not the store. :meth:`Postings.compact`
merges all segments into one. The list of segments is one small file, replaced by a rename.

Nothing here puts a whole term into one task: a term's postings are dealt over its blocks by a
hash of the record's number, and blocks are spread over tasks by range. Postings move once, with
numbers instead of ids, and a record's terms are summed where the record is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recallspark.functions.rank import broadcast_below, top_k
from recallspark.operators.index import explode_queries, parts, summed
from recallspark.schema import BM25_B, BM25_K1, IDF_FLOOR, TEXT_LIMIT, RecallError
from recallspark.session import settle
from recallspark.sources.files import read_text, replace_text

BUCKETS = 64
#: Postings per block, about.
BLOCK = 128
#: Blocks per question whose records give the first bound of the list.
FIRST = 64
#: Crowded groups, asked terms and found records go to every task up to so many rows (about 60 bytes each).
SHIPPED = 500_000
#: Far above the rounding of a sum, so ties are never skipped.
SLACK = 1e-6

KEY = ["project_id", "memory_id"]
NUMBER = ["segment", "doc"]
_ROWS = "doc bigint, project_id string, memory_id string, live boolean, dl double, entries array<struct<term:string,f:double>>"
_TABLES = {
    "rows": _ROWS,
    "gone": "of int, doc bigint",
    "postings": "project_id string, term string, block bigint, n bigint, max_f double, min_dl double, "
    "docs array<bigint>, fs array<double>, dls array<double>, bucket int",
    "blocks": "project_id string, term string, block bigint, n bigint, max_f double, min_dl double, bucket int",
    "terms": "project_id string, term string, df bigint, bucket int",
    "stats": "project_id string, n bigint, dl double",
}


def gain(f: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of weight ``f`` adds to a record of length ``dl``, for one times its rarity."""
    return f * (BM25_K1 + 1) / (f + BM25_K1 * ((1 - BM25_B) + BM25_B * dl / avgdl))


class Postings:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        held = read_text(spark, f"{self.root}/segments.json")
        state = json.loads(held) if held else {"buckets": buckets, "segments": []}
        self.buckets, self.segments = state["buckets"], state["segments"]

    # ------------------------------------------------------------- writing

    @classmethod
    def build(cls, index: DataFrame, root: str, buckets: int = BUCKETS, block: int = BLOCK) -> Postings:
        """Write the index of all rows (``project_id, memory_id, live, entries, dl``) as one segment."""
        made = cls(index.sparkSession, root, buckets)
        if made.segments:
            raise RecallError(f"an index is already kept under {root}")
        made._add(summed(index, [*KEY, "live"]), None, block, [])
        return made

    def refresh(self, index: DataFrame, gone: DataFrame, block: int = BLOCK) -> None:
        """New or changed records (index rows), and ``project_id, memory_id`` of removed ones."""
        touched = settle(index.select(*KEY).union(gone.select(*KEY)).distinct())
        before = settle(self._current(self._read("rows")).join(touched, KEY, "left_semi"))
        self._add(summed(index, [*KEY, "live"]), before, block, self.segments)

    def compact(self, block: int = BLOCK) -> None:
        """All segments as one, without the records that later ones replaced."""
        self._add(self.rows(), None, block, [])

    def _add(self, rows: DataFrame, before: DataFrame | None, block: int, earlier: list[str]) -> None:
        name = uuid.uuid4().hex
        path = f"{self.root}/{name}"
        rows.select(F.monotonically_increasing_id().alias("doc"), *KEY, "live", "dl", "entries").write.parquet(f"{path}/rows")
        gone = self.spark.createDataFrame([], _TABLES["gone"]) if before is None else before.select(F.col("segment").alias("of"), "doc")
        gone.write.parquet(f"{path}/gone")
        rows = self.spark.read.schema(_TABLES["rows"]).parquet(f"{path}/rows")
        group = ["project_id", "term", "f", "step"]
        found = rows.select("doc", "project_id", "live", "dl", F.inline("entries")).withColumn(
            "step", F.floor(F.log2(F.greatest("dl", F.lit(1.0)))).cast("int"))
        counts = settle(found.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("live").alias("n_live")))
        by = ["bucket", "project_id", "term"]
        self._blocks(found.where("live").drop("live"), counts, block).sortWithinPartitions(*by, "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = self.spark.read.schema(_TABLES["postings"]).parquet(f"{path}/postings")
        stored.drop("docs", "fs", "dls").sortWithinPartitions(*by).write.partitionBy("bucket").parquet(f"{path}/blocks")
        terms = counts.select("project_id", "term", "n")
        signed = rows.select("project_id", "dl", F.lit(1).alias("sign"))
        if before is not None:
            terms = terms.unionByName(before.select("project_id", F.explode("entries.term").alias("term"), F.lit(-1).cast("bigint").alias("n")))
            signed = signed.unionByName(before.select("project_id", "dl", F.lit(-1).alias("sign")))
        terms = terms.groupBy("project_id", "term").agg(F.sum("n").alias("df")).where("df <> 0").withColumn("bucket", self._bucket(F.col("term")))
        terms.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(f"{path}/terms")
        signed.groupBy("project_id").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("dl")).write.parquet(f"{path}/stats")
        self.segments = [*earlier, name]
        replace_text(self.spark, f"{self.root}/segments.json", json.dumps({"buckets": self.buckets, "segments": self.segments}))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _blocks(self, found: DataFrame, counts: DataFrame, block: int) -> DataFrame:
        """Postings of one project and term, by weight and doubling length, dealt into blocks by record.

        They are laid out by range of the block, so that grouping and writing need no second move.
        """
        group = ["project_id", "term", "f", "step"]
        crowded = settle(counts.where(F.col("n_live") > block).select(*group, F.ceil(F.col("n_live") / block).alias("_parts")))
        part = F.pmod(F.xxhash64("doc"), F.coalesce("_parts", F.lit(1))).cast("int")
        whole = ["bucket", *group, "part"]
        dealt = found.join(broadcast_below(crowded, SHIPPED), group, "left").select(
            self._bucket(F.col("term")).alias("bucket"), *group, part.alias("part"), "doc", "dl")
        return dealt.repartitionByRange(*whole).groupBy(*whole).agg(
            F.sort_array(F.collect_list(F.struct("doc", "dl"))).alias("held")
        ).select(
            "project_id", "term", F.xxhash64("f", "step", "part").alias("block"), F.size("held").cast("bigint").alias("n"),
            F.col("f").alias("max_f"), F.array_min("held.dl").alias("min_dl"), F.col("held.doc").alias("docs"),
            F.transform("held", lambda x: F.col("f")).alias("fs"), F.col("held.dl").alias("dls"), "bucket")

    # ------------------------------------------------------------- reading

    def _read(self, table: str, segments: list[str] | None = None) -> DataFrame:
        """One table of the named segments (all if not given), with each row's ``segment`` number."""
        names = self.segments if segments is None else segments
        out = None
        for name in names:
            part = self.spark.read.schema(_TABLES[table]).parquet(f"{self.root}/{name}/{table}").withColumn(
                "segment", F.lit(self.segments.index(name)))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], _TABLES[table] + ", segment int")

    def rows(self) -> DataFrame:
        """Every record's newest row."""
        return self._current(self._read("rows")).drop(*NUMBER)

    def _current(self, df: DataFrame) -> DataFrame:
        """Without the records (``segment, doc``) that a later segment replaces."""
        if len(self.segments) < 2:
            return df
        gone = self._read("gone", self.segments[1:]).select(F.col("of").alias("segment"), "doc")
        return df.join(broadcast_below(gone, SHIPPED), NUMBER, "left_anti")

    def statistics(self, by_project: bool = False) -> DataFrame:
        """``n, avgdl`` of all records, or of each project's."""
        df = self._read("stats")
        grouped = df.groupBy("project_id") if by_project else df.groupBy()
        return grouped.agg(F.sum("n").cast("double").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))

    def frequencies(self, terms: DataFrame, buckets: list[int], by_project: bool = False) -> DataFrame:
        """``term, df`` (and ``project_id``) of the asked terms."""
        group = ["project_id", "term"] if by_project else ["term"]
        held = self._read("terms").where(F.col("bucket").isin(buckets)).join(terms.select("term").distinct(), "term", "left_semi")
        return held.groupBy(*group).agg(F.sum("df").cast("double").alias("df"))

    def _asked(self, table: str, buckets: list[int], projects: list[str] | None) -> DataFrame:
        df = self._read(table).where(F.col("bucket").isin(buckets))
        return df.where(F.col("project_id").isin(projects)) if projects is not None else df

    def search(self, queries: DataFrame, limit: int = TEXT_LIMIT, by_project: bool = False, first: int = FIRST) -> DataFrame:
        """Best ``limit`` live records per question, as :func:`operators.index.bm25` finds them.

        1. The ``first`` blocks of a question by their bound give records with partial scores. The
           ``limit``-th best of those is a score the list certainly reaches.
        2. Terms whose bounds together stay below it cannot bring in a record on their own; the other
           terms lead. Of a leading term only postings count that, with all other terms at their best,
           reach it, and blocks whose bound reaches it for no question are not read.
        3. What is left moves once, a posting for all who ask for it, to where the record is summed up. A
           record whose leading terms, with the others at their best, stay below is dropped there.
        """
        terms = settle(explode_queries(queries).withColumn("bucket", self._bucket(F.col("term"))))
        # At most one value per bucket, and the projects asked about if they are few.
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
        asked = [r["project_id"] for r in terms.select("project_id").distinct().limit(65).collect()]
        projects = asked if len(asked) < 65 else None
        stats = self.statistics(by_project)
        df = self.frequencies(terms, buckets, by_project)
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        met = terms.join(df, ["project_id", "term"] if by_project else "term")
        met = met.join(stats, "project_id") if by_project else met.crossJoin(F.broadcast(stats))  # one row
        weights = settle(met.select(
            "query_id", "project_id", "term", "avgdl", (F.col("times") * F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)).alias("weight")))
        on = ["project_id", "term"]
        bounds = settle(self._asked("blocks", buckets, projects).join(weights, on).select(
            "query_id", *on, "segment", "block", "n", (F.col("weight") * gain(F.col("max_f"), F.col("min_dl"), F.col("avgdl"))).alias("bound")))
        peaks = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("peak"))
        most = peaks.groupBy("query_id").agg(F.sum("peak").alias("most"))

        held = self._asked("postings", buckets, projects)
        one = ["query_id", *NUMBER]
        opening = settle(top_k(bounds, ["query_id"], [F.col("bound").desc(), "term", "segment", "block"], first).join(
            weights, ["query_id", *on]).select("query_id", *on, "segment", "block", "weight", "avgdl"))
        met = held.join(broadcast_below(opening, SHIPPED), [*on, "segment", "block"])
        flat = self._current(met.select("query_id", "segment", "weight", "avgdl", _each()))
        partial = flat.select(*one, (F.col("weight") * gain(F.col("f"), F.col("dl"), F.col("avgdl"))).alias("gain")).groupBy(*one).agg(F.sum("gain").alias("part"))
        sure = top_k(partial, ["query_id"], [F.col("part").desc(), *NUMBER], limit).where(F.col("rn") == limit).select(
            "query_id", (F.col("part") - SLACK).alias("sure"))
        sure = settle(most.join(sure, "query_id", "left").withColumn("sure", F.coalesce("sure", F.lit(float("-inf")))))

        # Questions are short, so a question's terms are few rows.
        ladder = peaks.join(sure, "query_id").groupBy("query_id", "sure", "most").agg(
            F.array_sort(F.collect_list(F.struct("peak", "term"))).alias("steps"))
        below = F.aggregate(
            "steps", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("over")),
            lambda a, x: F.when(a["over"] | (a["sum"] + x["peak"] >= F.col("sure")), F.struct(a["sum"].alias("sum"), a["n"].alias("n"), F.lit(True).alias("over")))
            .otherwise(F.struct((a["sum"] + x["peak"]).alias("sum"), (a["n"] + 1).alias("n"), F.lit(False).alias("over"))))
        split = ladder.withColumn("below", below).select(
            "query_id", "sure", "most", F.col("below.sum").alias("rest"), F.posexplode("steps").alias("at", "step"), F.col("below.n").alias("n"))
        leads = F.col("at") >= F.col("n")
        # What a posting has to add for its record to reach the list; any posting of the other terms will do.
        least = F.when(leads, F.col("sure") - (F.col("most") - F.col("step.peak"))).otherwise(F.lit(float("-inf")))
        split = split.select(
            "query_id", F.col("step.term").alias("term"), leads.alias("leads"), least.alias("least"), (F.col("sure") - F.col("rest")).alias("reach"))
        asks = settle(split.join(weights, ["query_id", "term"]))
        ship = F.broadcast if asks.count() <= SHIPPED else (lambda df: df)
        asks = settle(asks.groupBy(*on).agg(F.collect_list(F.struct("query_id", "weight", "avgdl", "leads", "least", "reach")).alias("asks")).withColumn(
            "t", F.monotonically_increasing_id()))

        # Postings move once, by record and whoever asks for them; questions meet them where all of a record's are.
        open_ = held.join(ship(asks), on).where(F.exists(
            "asks", lambda a: a["weight"] * gain(F.col("max_f"), F.col("min_dl"), a["avgdl"]) >= a["least"]))
        flat = self._current(open_.select("segment", "t", _each()))
        work = bounds.agg(F.sum("n")).head()[0] or 0
        met = flat.repartition(parts(self.spark, work), *NUMBER).join(ship(asks.select("t", "asks")), "t").select(
            *NUMBER, "f", "dl", F.explode("asks").alias("a"))
        met = met.select("a.query_id", *NUMBER, "a.leads", "a.least", "a.reach", (F.col("a.weight") * gain(F.col("f"), F.col("dl"), F.col("a.avgdl"))).alias("gain"))
        scored = met.where("gain >= least").groupBy(*one).agg(
            F.round(F.sum("gain"), 9).alias("raw"), F.sum(F.when(F.col("leads"), F.col("gain"))).alias("part"), F.max("reach").alias("reach"))
        # Names decide between equals, so all equals of a list's last place are named.
        place = F.rank().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc()))
        near = settle(scored.where("part >= reach").withColumn("place", place).where(F.col("place") <= limit).select(*one, "raw"))
        names = self._read("rows").select(*NUMBER, "memory_id")
        named = names.join(broadcast_below(near, SHIPPED), NUMBER).select("query_id", "memory_id", "raw")
        best = top_k(named, ["query_id"], [F.col("raw").desc(), F.col("memory_id")], limit)
        best = best.join(queries.select("query_id", "project_id"), "query_id")
        top = F.max("raw").over(Window.partitionBy("query_id"))
        return best.withColumn("text", F.greatest(F.lit(0.0), F.col("raw") / F.when(top == 0, 1.0).otherwise(top)))


def _each() -> Column:
    """A block's postings as rows: ``doc, f, dl``."""
    return F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("fs").alias("f"), F.col("dls").alias("dl")))
