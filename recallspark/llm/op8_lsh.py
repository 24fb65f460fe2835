"""Nearest neighbours by inner product: multiprobe hashing with p-stable projections.

Vectors are scaled by the largest norm and get one more component that makes them unit
vectors; then the nearest by Euclidean distance is the largest by inner product. A table
hashes a vector by ``HASHES`` Gaussian projections cut into cells of width ``WIDTH``. A
neighbour at distance ``r`` falls into each cell around the query with a known probability,
so a query visits the cells of a table in the order of that probability until together
they hold such a neighbour with probability ``REACH``. ``r`` is the distance of the ``k``-th
nearest row of a bounded sample, the query itself left out: part of the rows cannot hold a
``k``-th neighbour nearer than that of all rows, so ``r`` is never too small. What the tables
find is ranked by the inner product of the original vectors, in double precision.

Rows and visits meet in bins of buckets; a bucket with too many rows is dealt over several
bins, all of which its visitors see. A bin passes on a query's nearest rows only. A query
that found fewer than ``k`` rows although there are more meets all rows in a second pass.

Recall is measured in the tests against brute force (0.97 or more on the given tables).
Defined results: vectors that are null, empty, zero or have a null or non-finite component,
rows without id, and vectors of another length than most take no part; equal scores are in
the order of ids; ids repeated with one vector are one candidate. Only named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.vectors import matrix, usable

HASHES, TABLES, WIDTH, REACH = 4, 3, 0.8, 0.75
SAMPLE, ROWS_PER_BIN = 32_768, 10_000
#: Cells to each side of the query's that are considered; what lies beyond is out of reach of any neighbour.
SPREAD = 4
_ERF = np.frompyfunc(math.erf, 1, 1)


class Tables:
    """The projections, and what is needed to hash rows and plan visits."""

    def __init__(self, dim: int, largest: float, ids: np.ndarray, known: np.ndarray, k: int, hashes: int, tables: int, width: float, reach: float):
        rng = np.random.default_rng(8)
        self.a, self.b = rng.normal(size=(dim + 1, tables * hashes)), rng.uniform(0, width, tables * hashes)
        self.dim, self.largest, self.ids, self.known, self.k = dim, largest, ids, known, k
        self.hashes, self.tables, self.width, self.reach = hashes, tables, width, reach
        steps = np.arange(-SPREAD, SPREAD + 1)
        self.moves = np.stack(np.meshgrid(*[steps] * hashes, indexing="ij"), axis=-1).reshape(-1, hashes)

    def keys(self, cells: np.ndarray, table) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.uint64) + blocks.mix(np.atleast_1d(np.asarray(table, np.uint64)) + np.uint64(1))
        for i in range(cells.shape[-1]):
            out = blocks.mix(out ^ (cells[..., i].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return out

    def row_keys(self, x: np.ndarray) -> np.ndarray:
        """One key per row and table."""
        x = x / self.largest
        extra = np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))
        cells = np.floor((np.hstack([x, extra]) @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)
        return self.keys(cells, np.arange(self.tables)[None, :])

    def radius(self, query: int, q: np.ndarray) -> float:
        """Distance of the sample's ``k``-th nearest row other than the query, which is not less than that of all rows."""
        near = np.maximum(2 - 2 * (self.known @ q) / self.largest, 1e-6)[self.ids != query]
        at = min(self.k, len(near)) - 1
        return math.sqrt(np.partition(near, at)[at]) if len(near) else math.sqrt(2)

    def visits(self, query: int, q: np.ndarray) -> np.ndarray:
        """Keys of the cells to visit, most promising first, table by table."""
        q = q / np.linalg.norm(q)
        r = self.radius(query, q)
        place = (np.append(q, 0.0) @ self.a + self.b) / self.width
        base = np.floor(place)
        edge = (base + np.arange(-SPREAD, SPREAD + 2)[:, None] - place) * self.width / r
        below = 0.5 * (1 + _ERF(edge / math.sqrt(2)).astype(float))
        chance = np.diff(below, axis=0)
        out = []
        for t in range(self.tables):
            mine = slice(t * self.hashes, (t + 1) * self.hashes)
            p = np.ones(1)
            for c in chance[:, mine].T:
                p = np.multiply.outer(p, c).reshape(-1)
            order = np.argsort(-p, kind="stable")
            enough = int(np.searchsorted(np.cumsum(p[order]), self.reach)) + 1
            out.append(self.keys(base[mine] + self.moves[order[:enough]], t))
        return np.concatenate(out)


def sample(rows: DataFrame, n: int, dim: int, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` of ``n`` rows with different ids, those with the smallest hash of the id."""
    most = max(2, min(most, 4_000_000 // dim))
    hashed = F.xxhash64("id")
    # Hashes spread evenly, so the smallest lie below this bound; only about twice the sample is sorted.
    low = -(1 << 63) + (1 << 64) * (2 * most + 1000) // max(n, 2 * most + 1000)
    got = rows.where(hashed <= F.lit(min(low, (1 << 63) - 1))).orderBy(hashed, "id").limit(most).toArrow()
    return got["id"].to_numpy(), matrix(got["vector"]) if len(got) else np.zeros((0, dim))


def _bin(key: Column, chunk: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key, chunk), F.lit(bins)).cast("int")


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, hashes: int = HASHES,
            tables: int = TABLES, width: float = WIDTH, reach: float = REACH, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``df`` found, itself excluded."""

    def clean(one):
        found = one.where(F.col(key).isNotNull() & usable(F.col(vector)))
        return found.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["id"])

    rows, asked = clean(df), clean(queries)
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    rows, asked = rows.where(F.size("vector") == dim), asked.where(F.size("vector") == dim)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most")).first()
    model = Tables(dim, (size["most"] or 1.0) * (1 + 1e-12), *sample(rows, size["n"], dim), k, hashes, tables, width, reach)
    sent = df.sparkSession.sparkContext.broadcast(model)
    bins = max(1, -(-tables * size["n"] // rows_per_bin))

    def hash_rows(batches):
        for batch in batches:
            if batch.num_rows:
                keys = sent.value.row_keys(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))], ["id", "vector", "keys"])

    def plan_visits(batches):
        for batch in batches:
            if batch.num_rows:
                keys = [sent.value.visits(i, q).view(np.int64).tolist() for i, q in zip(batch.column(0).to_numpy(), matrix(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["id", "vector", "keys"])

    shape = "id bigint, vector array<double>, keys array<bigint>"
    hashed = rows.mapInArrow(hash_rows, shape)
    placed = settle(hashed.select("id", "vector", F.explode("keys").alias("key")))
    # Crowded buckets are dealt over chunks. There are at most 100,000, whatever the size of the table.
    crowded = max(rows_per_bin, -(-tables * size["n"] // 100_000))
    hot = settle(placed.groupBy("key").count().where(F.col("count") > crowded).select("key", F.ceil(F.col("count") / crowded).cast("int").alias("chunks")))
    placed = placed.join(F.broadcast(hot), "key", "left")
    chunk = F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")
    data = placed.select(_bin(F.col("key"), chunk, bins).alias("bin"), F.lit(0).alias("kind"), "id", "vector", F.array("key").alias("keys"))
    visits = asked.repartition(blocks.parts(asked)).mapInArrow(plan_visits, shape).select("id", "vector", F.explode("keys").alias("key")).join(F.broadcast(hot), "key", "left")
    visits = visits.select("id", "vector", "key", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    # A query comes to a bin once, with all the buckets it visits there.
    visits = visits.groupBy("id", _bin(F.col("key"), F.col("chunk"), bins).alias("bin")).agg(F.first("vector").alias("vector"), F.collect_list("key").alias("keys"))
    both = data.unionByName(visits.select("bin", F.lit(1).alias("kind"), "id", "vector", "keys"))

    def meet(batches):
        at, ids, x, key = None, [], [], []
        ready = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            number, vectors, keys = batch.column(2).to_numpy(), matrix(batch.column(3)), batch.column(4)
            out = []
            cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(cut, np.append(cut[1:], len(group))):
                if group[a] != at:
                    at, ids, x, key, ready = group[a], [], [], [], None
                if kind[a] == 0:
                    ids.append(number[a:b]), x.append(vectors[a:b]), key.append(keys[a:b].flatten().to_numpy())
                    continue
                if ready is None and ids:
                    order = np.argsort(np.concatenate(key), kind="stable")
                    ready = np.concatenate(key)[order], np.concatenate(ids)[order], np.concatenate(x)[order]
                if ready is not None:
                    for i in range(a, b):
                        out.append(_best(number[i], vectors[i], keys[i].values.to_numpy(), *ready, k))
            if out:
                q, v, s = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    def ranked(both):
        dealt = both.repartition(bins, "bin").sortWithinPartitions("bin", "kind")
        found = dealt.mapInArrow(meet, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = settle(ranked(both))
    # At most n rows can be found, and n - 1 by a query that is one of them.
    full = first.groupBy("query_id").count().where(F.col("count") >= min(k, size["n"])).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if size["n"] <= k:
        itself = rows.select("id").withColumn("others", F.lit(size["n"] - 1))
        counted = first.groupBy(F.col("query_id").alias("id")).count()
        short = short.join(counted, "id", "left").join(itself, "id", "left").where(F.coalesce("count", F.lit(0)) < F.coalesce("others", F.lit(size["n"]))).select("id", "vector")
    short = settle(short)
    if short.isEmpty():
        return first
    every = F.array(F.lit(0).cast("bigint"))
    blocks_of = rows.select(F.pmod(F.xxhash64("id"), F.lit(bins)).cast("int").alias("bin"), F.lit(0).alias("kind"), "id", "vector", every.alias("keys"))
    asks = short.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(1).alias("kind"), "id", "vector", every.alias("keys"))
    second = ranked(blocks_of.unionByName(asks))
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*second.columns).unionByName(second)


def _best(query: int, q: np.ndarray, wanted: np.ndarray, key: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """The query's ``k`` nearest rows in the wanted buckets of a bin."""
    low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    some = high > low
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(low[some], high[some]))])
    _, first = np.unique(ids[at], return_index=True)
    at = at[first]
    at = at[ids[at] != query]
    score = x[at] @ q
    if len(at) > k:
        # Those that rounding could bring among the nearest are measured again, each in the same order of additions.
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = at[score >= least - 1e-9 * (1 + abs(least))]
    score = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return np.full(len(order), query), ids[at][order], score[order]


def query(spark, sf_dir: str) -> DataFrame:
    rows = blocks.read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op8_multiprobe_lsh": query}
#: The search is approximate; the tests measure recall against brute force.
ORACLES: dict[str, str] = {}
