"""Spelling variants of words: asymmetric q-chunks find every pair that one edit parts.

Of two words the one that is not longer is cut: it contributes two disjoint chunks, its first
and its last ``length // 2`` characters. The other contributes positional grams of that length.
One insertion, deletion or replacement leaves one of the two chunks whole, and moves it by the
difference of the lengths at most, so of all positional grams only those at a chunk's place or
one further are sent. Words meet where chunk and gram agree; what meets is verified.

A chunk that very many words share (a common prefix) is split and not paired: what is left of
each word beside the chunk again differs by one edit, so its own two chunks and grams are the
keys of a further round, until a key's pairs are few or one letter is left.

Defined results: null and empty texts have no words; a null id counts as an empty one; repeated
rows count again; ties go to the word that is smaller in code-point order; a run of any length
is a word. Only the named columns are read, so further columns cannot clash. An empty table
gives an empty result. Counting is by Arrow batches; all that follows is DataFrame code.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.op9_bpe import ragged

#: A run is changed where this divides its checksum; words are this long and this frequent at least.
EVERY, SHORTEST, LEAST = 31, 7, 2
#: A form is this many times as frequent as the word.
TIMES = 10
#: Pairs of one key that a task may compare; a key with more is split.
MOST_PAIRS = 250_000
#: Longer runs are summed by the library one by one.
_STEPS = 64


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_CRC = _crc_table()


def letter_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    lower = buf | 0x20
    inside = (lower >= 0x61) & (lower <= 0x7A) & (buf < 0x80) | (buf == 0xC3)
    inside[1:] |= buf[:-1] == 0xC3
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``crc32`` of every ``buf[start:end]``, going on from the checksum ``before`` it."""
    order = np.argsort(start - end, kind="stable")  # longest first
    s, length = start[order], (end - start)[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-length, -_STEPS, "left"))
    for i in range(long):
        raw = buf[s[i]: s[i] + length[i]].tobytes()
        state[i] = np.uint32(zlib.crc32(raw, int(before[order[i]])) ^ 0xFFFFFFFF)
    for j in range(int(length[long]) if long < len(length) else 0):
        to = int(np.searchsorted(-length, -j, "left"))  # runs of more than j bytes
        state[long:to] = _CRC[(state[long:to] ^ buf[s[long:to] + j]) & np.uint32(0xFF)] ^ (state[long:to] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(buf: np.ndarray, offs: np.ndarray, ids: list[str], every: int, shortest: int) -> pa.Array:
    """The words of a slice of texts, one entry per occurrence."""
    buf = blocks.LOWER[buf]
    start, end, row = letter_runs(buf, offs)
    lead = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    points = lead[end] - lead[start]
    start, end, row, points = (x[points >= shortest] for x in (start, end, row, points))
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = checksums(buf, start, end, before[row])
    changed = crc % np.uint32(every) == 0
    at = ragged(start, end - start)
    keep = np.ones(len(at), bool)
    into = np.append(0, np.cumsum(end - start))
    place = np.flatnonzero((buf & 0xC0) != 0x80)  # where each code point starts
    gone = place[lead[start[changed]] + crc[changed].astype(np.int64) % points[changed]]
    drop = into[:-1][changed] + gone - start[changed]
    keep[drop] = False
    wide = buf[gone] == 0xC3
    keep[drop[wide] + 1] = False
    length = (end - start).copy()
    length[changed] -= 1 + wide
    bounds = np.append(0, np.cumsum(length))
    found = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buf[at[keep]])])
    return found.filter(pa.array(points - changed >= shortest))


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY,
               shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: every word with at least ``least`` occurrences in all texts."""
    source = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            ids, (buf, offs) = batch.column(0), blocks.flat(batch.column(1))
            for a, b in blocks.slices(offs):
                found = words_of(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], ids.slice(a, b - a).to_pylist(), every, shortest)
                counts = found.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])

    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut(path: Column, length: Column, which: int, gram: Column) -> Column:
    return F.xxhash64(path, length, F.lit(which), gram)


def chunks(rest: DataFrame) -> DataFrame:
    """Each word's own two chunks: ``key``, ``word, n, rest`` and what is ``left`` beside the chunk."""
    r, m = F.col("rest"), F.length("rest")
    q = (m / 2).cast("int")
    cut = F.array(
        F.struct(_cut(F.col("path"), m, 0, F.left(r, q)).alias("key"), F.substring(r, q + 1, m).alias("left"), (m - q > 1).alias("more")),
        F.struct(_cut(F.col("path"), m, 1, F.right(r, q)).alias("key"), F.left(r, m - q).alias("left"), (m - q > 1).alias("more")))
    return rest.select("word", "n", "rest", F.inline(cut))


def grams(rest: DataFrame) -> DataFrame:
    """Each word's positional grams, for chunks of words as long and one shorter."""
    r, m = F.col("rest"), F.length("rest")
    cut = []
    for shorter in (0, 1):
        length = F.greatest(m - shorter, F.lit(0))
        q = (length / 2).cast("int")
        for which in (0, 1):
            # The first chunk keeps its place; the last one moves by the difference of the lengths.
            at = F.lit(1) if which == 0 else m - q + 1
            left = F.substring(r, q + 1, m) if which == 0 else F.left(r, m - q)
            cut.append(F.when(m >= shorter, F.struct(
                _cut(F.col("path"), length, which, F.substring(r, at, q)).alias("key"), left.alias("left"))))
    return rest.select("word", "n", "rest", F.inline(F.filter(F.array(*cut), lambda x: x.isNotNull())))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``a, na, b, nb``: every pair of distinct words that one edit parts, once.

    ``words`` holds each ``word`` once, with ``n``.
    """
    rest = words.select("word", "n", F.col("word").alias("rest"), F.lit(0).cast("bigint").alias("path"))
    found = None
    while True:
        mine, theirs = chunks(rest), grams(rest)
        sizes = mine.groupBy("key").agg(F.count("*").alias("x"), F.max("more").alias("more")).join(
            theirs.groupBy("key").agg(F.count("*").alias("y")), "key")
        hot = settle(sizes.where(F.col("more") & (F.col("x") * F.col("y") > most_pairs)).select("key"))
        a = mine.join(hot, "key", "left_anti").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        b = theirs.join(hot, "key", "left_anti").select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
        size = F.length("b") - F.length("a")
        met = a.join(b, "key").where(((size == 1) | (size == 0) & (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        met = settle(met.select("a", "na", "b", "nb").distinct())
        found = met if found is None else found.union(met)
        if hot.isEmpty():
            return found.distinct()
        # A word is cut again in each of its hot keys, in both roles at once.
        again = mine.join(hot, "key", "left_semi").select("word", "n", "left", "key").union(
            theirs.join(hot, "key", "left_semi").select("word", "n", "left", "key"))
        rest = settle(again.select("word", "n", F.col("left").alias("rest"), F.col("key").alias("path")).distinct())


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for every ``word, form``: the end of its chain, by doubling the step each round.

    A form is at least ``TIMES`` as frequent as its word, so chains are short and never close.
    """
    now = settle(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every ``word, n``."""
    words = settle(words)
    pairs = near_pairs(words, most_pairs)
    order = F.struct((-F.col("m")).alias("rank"), F.col("other").alias("word"))
    own = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("bigint").alias("m"))
    one = pairs.select(F.col("a").alias("word"), F.lit(None).cast("bigint").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    two = pairs.select(F.col("b").alias("word"), F.lit(None).cast("bigint").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))
    best = own.union(one).union(two).groupBy("word").agg(
        F.max("n").alias("n"), F.count("other").alias("n_near"), F.min(F.when(F.col("other").isNotNull(), order)).alias("best"))
    taken = -F.col("best.rank") >= times * F.col("n")
    forms = settle(best.select(
        "word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n")))
    ends = roots(forms.where("form is not null").select("word", "form"))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(blocks.read(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling": query}
ORACLES = {"op11_spelling": r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents),
g AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r WHERE length(w) >= 7 GROUP BY d, w),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substring(x, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t.t[xor(c & 255, b) + 1]))) AS h
  FROM g, t),
v AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM h)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
p AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
k AS (SELECT w, n, i, substring(w, 1, i - 1) AS x, substring(w, i + 1) AS y FROM p),
e AS (
  SELECT a.w, b.w AS o, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.w <> b.w
  UNION SELECT k.w, v.w, v.n FROM k JOIN v ON v.w = k.x || k.y
  UNION SELECT v.w, k.w, k.n FROM k JOIN v ON v.w = k.x || k.y),
b AS (SELECT w, count(*) AS n_near, arg_min(o, (-m, o)) AS f, max(m) AS m FROM e GROUP BY w),
f AS (
  SELECT v.w, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * v.n THEN b.f END AS form, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n
  FROM v LEFT JOIN b ON b.w = v.w),
c AS (SELECT w, w AS at, 0 AS step FROM f UNION ALL SELECT c.w, f.form, step + 1 FROM c JOIN f ON f.w = c.at WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, arg_max(c.at, c.step) AS root, any_value(f.n) AS n, any_value(f.n_near) AS n_near, any_value(f.form_n) AS form_n
FROM f JOIN c ON c.w = f.w GROUP BY f.w, f.form
"""}
