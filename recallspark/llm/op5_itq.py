"""Near-duplicate embeddings by iterative quantisation.

On a bounded sample a rotation is learned that makes the signs of the rotated principal
components a balanced code with little quantisation error. Every vector gets its code; the
code is cut into ``TABLES`` pieces, and vectors of one label meet where a piece differs in
one bit at most, which finds every pair of codes less than ``2 * TABLES`` bits apart and many
beyond. Candidates within ``NEAR`` bits are compared by the cosine of the original vectors.

Equal vectors of a label are one class with a count; only the class goes through the tables.
Links found are all at or above the threshold; the share of links found is measured in the
tests against brute force (0.999 on the given tables).

Defined results: a vector that is null, empty, zero or has a null or non-finite component, a
row without label or id, and a vector of another length than its partner link with nothing;
ids repeated with the same vector count once. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.links import components
from recallspark.llm.vectors import matrix, sample, usable

THRESHOLD = 0.98
SAMPLE, ROUNDS = 20_000, 50
BITS, TABLES, NEAR = 64, 4, 16


def learn(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (principal components, then the learned rotation) of unit vectors."""
    d = vectors.shape[1]
    bits = min(bits, d)
    if len(vectors) < 2:
        return np.zeros(d), np.eye(d)[:, :bits]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(unit - mean, rowvar=False).reshape(d, d))
    axes = axes[:, ::-1][:, :bits]
    seen = (unit - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(seen @ rotation >= 0, 1.0, -1.0).T @ seen)
        rotation = (u @ v).T
    return mean, axes @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (unit - mean) @ projection >= 0
    return (signs * (np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def coded(classes: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """``rep, label, code`` of vectors as long as the model's; others cannot be coded and come without code."""
    d, bits = len(mean), projection.shape[1]

    def run(batches):
        for batch in batches:
            fits = np.array([len(x) == d for x in batch.column(2)], bool)
            code = np.zeros(len(fits), np.uint64)
            if fits.any():
                code[fits] = codes(matrix(batch.column(2).filter(pa.array(fits))), mean, projection)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.view(np.int64), mask=~fits)], ["rep", "label", "code"])

    return classes.select("rep", "label", "vector").mapInArrow(run, f"rep bigint, label {classes.schema['label'].dataType.simpleString()}, code bigint")


def candidates(coded_rows: DataFrame, bits: int, tables: int, near: int) -> DataFrame:
    """``a, b``: pairs of one label with a code piece at most one bit apart, and codes within ``near``."""
    edges = [i * bits // tables for i in range(tables + 1)]
    width = [edges[i + 1] - edges[i] for i in range(tables)]
    piece = [F.shiftrightunsigned("code", edges[i]).bitwiseAND(F.lit((1 << width[i]) - 1)) for i in range(tables)]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), piece[i].alias("v")) for i in range(tables)]))
    flips = [F.struct(F.lit(i).alias("t"), piece[i].bitwiseXOR(F.lit(f)).alias("v")) for i in range(tables) for f in (0, *(1 << j for j in range(width[i])))]
    index = coded_rows.select("label", F.col("rep").alias("a"), F.col("code").alias("x"), own.alias("k")).select("label", "k.t", "k.v", "a", "x")
    probe = coded_rows.select("label", F.col("rep").alias("b"), F.col("code").alias("y"), F.explode(F.array(*flips)).alias("k")).select("label", "k.t", "k.v", "b", "y")
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # A small file of codes is many rows here: by its size Spark would send them all through the driver.
    return index.join(probe.hint("merge"), ["label", "t", "v"]).where((F.col("a") < F.col("b")) & (apart <= near)).select("a", "b").distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those ``a, b`` whose cosine, in double precision, reaches the threshold."""
    one = lambda c, v: classes.select(F.col("rep").alias(c), F.col("vector").alias(v))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column(2)), matrix(batch.column(3))
            cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            near = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    both = pairs.join(one("a", "x").hint("merge"), "a").join(one("b", "y").hint("merge"), "b").where(F.size("x") == F.size("y"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                 most: int = SAMPLE, tables: int = TABLES, near: int = NEAR) -> DataFrame:
    """Per row: the key, ``n_links``, ``component_id`` and ``kept``."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    rows = rows.select("id", "label", F.when(sound, F.col("vector")).alias("vector"))
    rows = rows.withColumn("h1", F.when(sound, F.xxhash64("vector"))).withColumn("h2", F.when(sound, F.xxhash64(F.lit(7), "vector")))
    taking = rows.where("h1 is not null")
    ids = taking.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("times"))
    classes = settle(taking.join(ids, ["label", "h1", "h2"]).where("id = rep").groupBy("rep", "label", "h1", "h2", "times").agg(F.first("vector").alias("vector")))
    mean, projection = learn(sample(classes, "rep", "vector", most))
    made = settle(coded(classes, mean, projection).where("code is not null"))
    links = settle(verified(candidates(made, projection.shape[1], min(tables, projection.shape[1]), near), classes, threshold))

    times = classes.select(F.col("rep").alias("b"), "times")
    both = links.union(links.select("b", "a"))
    # Links are written in few bytes each, so the size of their files says little of the room they take in the driver.
    linked = both.join(times.hint("merge"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("times").alias("others"))
    found = components(links).toDF("rep", "component")
    per_class = (classes.drop("vector").join(linked.hint("merge"), "rep", "left").join(found.hint("merge"), "rep", "left")
                 .select("label", "h1", "h2", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")))
    out = rows.drop("vector").join(per_class.hint("merge"), ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(blocks.read(spark, sf_dir, "embeddings"))


QUERIES = {"op5_itq_near_vectors": query}
#: Hamming tables may miss a link, so the tests compare with brute force instead of SQL.
ORACLES: dict[str, str] = {}
