"""Whole texts as flat byte arrays: the vectorised steps that several operators share.

A batch of texts becomes one ``uint8`` array and its offsets, cut at text boundaries
into slices of about ``SLICE`` bytes so that the working arrays of a task stay small
whatever the batch holds. A single longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recallspark import session

SLICE = 1 << 20
#: ASCII white space, bytes 0x20 and 0x09 to 0x0D: what ends a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shape(source: DataFrame, key: str, rest: str) -> T.StructType:
    """The key's own field, whatever its type, and further fields."""
    return T.StructType([source.schema[key], *T.StructType.fromDDL(rest).fields])


def remainder(column, by: int):
    """``crc32`` of an id's text modulo ``by``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by, F.lit(0)).cast("int")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, at least one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, SLICE + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have if size <= 4 * SLICE else _powers[kind]
    return have[:n]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``buf[start:end]``, from prefix sums of a byte polynomial."""
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * _power("up", len(buf)), out=total[1:])
    value = (total[end] - total[start]) * _power("down", len(buf) + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than white space."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's run in a sorted row index."""
    return np.searchsorted(rows, np.arange(n + 1))


def release() -> None:
    """Give the memory that a task has freed back to the machine; allocators keep it otherwise, and a worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that calls ``release`` once its batches have gone through."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def settle(df: DataFrame) -> DataFrame:
    """A step written to shared storage and read back, the disk of the steps before it freed first.

    Spark removes shuffle files once the driver has collected what refers to them, which a
    quiet driver may put off for half an hour; a run of many steps asks for it. What the last
    write used is still referred to when it returns, hence before the next one.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return session.settle(df)


def discard(step: DataFrame) -> None:
    """Remove the files of a settled step that nothing reads any more."""
    context = step.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in step.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI.create(folder))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
