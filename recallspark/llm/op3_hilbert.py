"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension (numbers as they are, text by its first six bytes) is cut into ``2**bits``
equal steps between its smallest and largest value. Rows are ordered by the Hilbert index
of their cell, so that rows near each other in the order are near each other in every
dimension, and the order is cut into runs, one per shard, whose row counts differ by one
at most. Readers that filter on any of the dimensions then skip most files by their
minimum and maximum.

Cells are bounded in number, so their counts, and the counts of the parts that a crowded
cell is dealt into, give every row its position without a total sort.

Defined results: null values lie in step 0, as does a dimension without spread; null texts
have 0 bytes; ties are in the order of the part (a hash of the id), the text's checksum, the
id, and the size; repeated rows get places of their own. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.ranks import numbered

SHARDS, BITS = 8, 3


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (one row each), by Gray-code transposition."""
    axes = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    for level in reversed(range(1, bits)):
        top, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            high = (axis & top) > 0
            swap = np.where(high, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(high, below, 0) if i else np.where(high, below, swap)
            if i:
                axes[0] ^= swap
                axis ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in reversed(range(1, bits)):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    out = np.zeros_like(axes[0])
    for level in reversed(range(bits)):
        for axis in axes:
            out = (out << 1) | (((axis ^ turn) >> level) & 1)
    return out


def ordinal(text: Column) -> Column:
    """The first six bytes of a text as a number in the same order."""
    head = F.substring(text.cast("binary"), 1, 6)
    return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")


def steps(df: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """Each dimension's step, from the extremes of the whole table."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = []
    for c in dimensions:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        wide = high is not None and high > low
        step = F.floor((F.col(c) - F.lit(low)) * F.lit(float(1 << bits)) / F.lit(high - low)) if wide else F.lit(0)
        out.append(F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0)).cast("int"))
    return out


def shard(df: DataFrame, dimensions: list[str], key: str = "doc_id", tie: str | None = None, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``cell`` (Hilbert index), ``shard`` and ``slot``; numeric ``dimensions`` are columns of ``df``."""
    index = F.pandas_udf(lambda *x: pd.Series(hilbert_index(np.stack([c.to_numpy() for c in x], axis=1), bits)), "long")
    df = df.withColumn("cell", index(*steps(df, dimensions, bits)))
    total = df.count()
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    last = [F.col(c).asc_nulls_last() for c in ([tie] if tie else []) + [key]]
    out = numbered(df, [], ["cell"], last, F.pmod(F.xxhash64(name), F.lit(1 << 40)), total)
    # The first ``total % shards`` shards hold one row more.
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    position = F.col("position")
    number = F.when(position < edge, F.floor(position / (small + 1))).otherwise(more + F.floor((position - edge) / max(small, 1)))
    start = F.col("shard") * small + F.least(F.col("shard"), F.lit(more))
    return out.withColumn("shard", number.cast("int")).withColumn("slot", (position - start).cast("bigint")).drop("position")


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of the curve, each file's statistics narrow."""
    sharded.repartitionByRange(blocks.parts(sharded), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_dimensions(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The id, ``size``, ``text_crc32`` and the four dimensions of documents; no text goes on."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    return docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        ordinal(F.col(lang)).alias("x_lang"), ordinal(F.col(source)).alias("x_source"), F.log2(size.cast("double")).alias("x_size"),
        F.col(key).cast("double").alias("x_id"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = settle(document_dimensions(blocks.read(spark, sf_dir, "documents")))
    out = shard(rows, ["x_lang", "x_source", "x_size", "x_id"], tie="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "cell")


QUERIES = {"op3_hilbert_shards": query}
#: SQL has no CRC-32 of a text; the tests compare with a plain sort.
ORACLES: dict[str, str] = {}
