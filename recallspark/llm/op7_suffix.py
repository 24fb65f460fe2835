"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a ``length``-byte string that covers it also starts earlier: in a smaller
document, or earlier in the same one. Suffixes are dealt to shards so that strings which
share ``length`` bytes meet: every window of that length is assigned the smallest-ranked
``GRAM``-byte gram inside it, and a maximal run of windows with the same gram is one string
under that gram's key, about 35 windows long. A key with one string has no repeats and
goes no further. Equal strings under a key have equal suffixes, so all but the first are
removed whole and the first stands for them. Where different strings share a key, they are
fetched from the texts and laid end to end into shards; each shard's suffix array is made
by induced sorting (suffix types, leftmost-smaller substrings sorted by an induction, their
order refined by doubling their names, and the full order induced from them), then the
permuted common prefixes; suffixes in a row with ``length`` bytes in common are repeats.

The induction runs bucket by bucket over whole arrays. A key with more than ``cap``
different strings (one common line in a great many contexts) is not laid into one shard:
its windows are grouped by their hashes, exactly and spread over all tasks. Nothing is
dropped on either way.

Keys and equality of strings rest on two 64-bit hashes. Defined results: null texts are
empty; texts shorter than ``length`` keep all; documents without an id come after all
others, ordered by a hash of their text; rows that repeat an id are one document seen more
than once (what is removed from one of them is removed from all). Only named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle

LENGTH, GRAM = 100, 24
#: Bytes laid into one suffix array, if a single key does not need more.
SHARD = 1 << 20
#: Most different strings of a key that one shard takes.
CAP = 50_000
_SYMBOL = np.random.default_rng(77).integers(0, 1 << 63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_rank(buf: np.ndarray) -> np.ndarray:
    """A 32-bit rank of the ``GRAM`` bytes from each position on (the last few say nothing)."""
    table = (blocks._BYTE >> np.uint64(20)).astype(np.uint32)
    one = np.concatenate([table[buf], np.zeros(GRAM, np.uint32)])

    def joined(left, right, shift, factor):
        out = left * np.uint32(factor)
        out[:-shift] += right[shift:]
        out ^= out >> np.uint32(15)
        return out

    two = joined(one, one, 1, 0x9E3779B1)
    four = joined(two, two, 2, 0x85EBCA77)
    eight = joined(four, four, 4, 0xC2B2AE3D)
    sixteen = joined(eight, eight, 8, 0x27D4EB2F)
    out = joined(sixteen, eight, 16, 0x165667B1) * np.uint32(0x85EBCA6B)
    return (out ^ (out >> np.uint32(13)))[: len(buf)]


def anchored_runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, gram position and row of every run of windows with one gram."""
    none = (np.zeros(0, np.int64),) * 4
    n, size = len(buf), np.diff(offs)
    if not (size >= length).any():
        return none
    ranked = (gram_rank(buf).astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    while 2 * have <= span:
        ranked = np.minimum(ranked[:-have], ranked[have:])
        have *= 2
    if have < span:
        ranked = np.minimum(ranked[: have - span], ranked[span - have:])
    step = np.zeros(n + 1, np.int64)
    whole = size >= length
    np.add.at(step, offs[:-1][whole], 1)
    np.add.at(step, offs[1:][whole] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(step[: len(ranked)]))
    gram = (ranked[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[first], np.diff(np.append(first, len(at))), gram[first], np.searchsorted(offs, at[first], "right") - 1


# --- suffix arrays -------------------------------------------------------------------------

def _induce(t, small, seeds, counts, tails):
    """Suffix array from seeds in order: first the larger-type suffixes, left to right, then the smaller."""
    n, alphabet = len(t), np.flatnonzero(counts)
    heads = tails - counts
    out = np.zeros(n, np.int64)
    by = seeds[np.argsort(t[seeds], kind="stable")]
    n_seeds = np.bincount(t[by], minlength=len(counts))
    seed_end = np.cumsum(n_seeds)
    next_l = heads.copy()

    def put(batch, kind, free, down):
        before = batch[batch > 0] - 1
        before = before[small[before] == kind]
        if not len(before):
            return
        char = t[before]
        order = np.argsort(char, kind="stable")
        before, char = before[order], char[order]
        start = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
        size = np.diff(np.append(start, len(char)))
        rank = np.arange(len(char)) - np.repeat(start, size)
        used = char[start]
        place = free[char] - 1 - rank if down else free[char] + rank
        out[place] = before
        free[used] += -size if down else size

    for c in alphabet:
        done = heads[c]
        while done < next_l[c]:
            to = next_l[c]
            put(out[done:to], False, next_l, False)
            done = to
        put(by[seed_end[c] - n_seeds[c]: seed_end[c]], False, next_l, False)
    next_s = tails.copy()
    for c in alphabet[::-1]:
        if c == 0:
            out[0] = n - 1
            continue
        done = tails[c]
        while done > next_s[c]:
            to = next_s[c]
            put(out[to:done][::-1], True, next_s, True)
            done = to
        put(out[heads[c]: next_l[c]][::-1], True, next_s, True)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t``, small integers that end in the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.append(t[:-1] != t[1:], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    small = np.append(t[:-1] < t[1:], True)[nearest]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(t, minlength=len(_SYMBOL))
    tails = np.cumsum(counts)
    first = _induce(t, small, lms, counts, tails)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    end = np.append(lms[1:], n - 1) + 1
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[t] * blocks._power("up", n), out=total[1:])
    value = (total[end] - total[lms]) * blocks._power("down", n + 1)[lms]
    which = number[ordered]
    same = (value[which][1:] == value[which][:-1]) & ((end - lms)[which][1:] == (end - lms)[which][:-1])
    name = np.zeros(len(lms), np.int64)
    name[which] = np.concatenate([[0], np.cumsum(~same)])
    order, step, m = which, 1, len(lms)
    while name.max() < m - 1:
        key = name * np.int64(m + 1)
        key[:-step] += name[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        name[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2
    return _induce(t, small, lms[order], counts, tails)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, how much its suffix shares with the one before it in order (up to ``most``).

    Where the neighbour is the previous position's neighbour moved by one, the value is the
    previous one less one; only the other positions are compared, by halving lengths of hashes.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[np.maximum(before[:-1], 0)])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[t] * blocks._power("up", n), out=total[1:])
    down = blocks._power("down", n + 1)

    def compared(at):
        other = before[at]
        low, high = np.zeros(len(at), np.int64), np.minimum(most, n - np.maximum(at, other))
        while (low < high).any():
            half = (low + high + 1) // 2
            equal = (total[at + half] - total[at]) * down[at] == (total[other + half] - total[other]) * down[other]
            low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
        return low

    out = np.zeros(n, np.int64)
    at = np.flatnonzero(fresh & (before >= 0))
    out[at] = compared(at)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    known = out[lead]
    out = np.where(fresh, out, known - (np.arange(n) - lead))
    # Behind a value that was cut at ``most`` nothing is known yet.
    at = np.flatnonzero(~fresh & (known >= most))
    out[at] = compared(at)
    return out


def repeated_windows(strings: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window of the strings that another of them holds earlier."""
    size = np.array([len(s) for s in strings], np.int64)
    joined = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    t = joined.astype(np.int16) + 2
    ends = np.cumsum(size + 1)
    t[ends - 1] = 1
    t[-1] = 0
    begin = ends - 1 - size
    of = np.repeat(np.arange(len(strings)), size + 1)
    left = np.append((ends - 1)[of] - np.arange(len(of)), 0)  # bytes of its own string from each position on
    order = suffix_array(t)
    shared = permuted_prefixes(t, order, int(size.max()))
    alike = np.zeros(len(t), bool)
    alike[1:] = (shared[order[1:]] >= length) & (left[order[1:]] >= length) & (left[order[:-1]] >= length)
    group = np.cumsum(~alike)
    inside = alike | np.append(alike[1:], False)
    position, group = order[inside], group[inside]
    document, start = ids[of[position]], starts[of[position]] + position - begin[of[position]]
    by = np.lexsort((start, document, group))
    document, start, group = document[by], start[by], group[by]
    lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(group) else group
    later = (document != document[first]) | (start != start[first])
    return document[later], start[later]


# --- the operator --------------------------------------------------------------------------

def _merged(document: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    if not len(low):
        return document, low, size
    order = np.lexsort((low, document))
    document, low, high = document[order], low[order], (low + size)[order]
    first = np.concatenate([[True], document[1:] != document[:-1]])
    group = np.cumsum(first) - 1
    # Running maximum of the ends, document by document: lift each document above the one before.
    lift = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + lift)
    new = first.copy()
    new[1:] |= (low + lift)[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return document[start], low[start], reach[np.append(start[1:] - 1, len(low) - 1)] - lift[start] - low[start]


def _table(columns, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), k) for x, k in zip(columns, kinds)], names)


def strings_of(docs: DataFrame, length: int) -> DataFrame:
    """``key, hash, id, low, size``: every string's gram, content, and place, once per batch;
    ``sure`` rows are places that repeat an earlier one of the batch."""
    names, kinds = ["key", "hash", "id", "low", "size", "sure"], ["i8", "i8", "i8", "i4", "i4", "?"]

    @blocks.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offs = blocks.flat(batch.column(1))
            parts = []
            for a, b in blocks.slices(offs):
                here, within = buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
                low, n, gram, row = anchored_runs(here, within, length)
                if len(low):
                    size = n + length - 1
                    parts.append((blocks.span_hash(here, gram, gram + GRAM), blocks.span_hash(here, low, low + size),
                                  ids[a:b][row], low - within[row], size))
            if not parts:
                continue
            key, hash_, doc, low, size = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((low, doc, hash_, key))
            key, hash_, doc, low, size = (x[order] for x in (key, hash_, doc, low, size))
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (hash_[1:] != hash_[:-1])])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = (doc != doc[lead]) | (low != low[lead])
            d, l, s = _merged(doc[later], low[later], size[later])
            yield _arrow((key[first].view(np.int64), hash_[first].view(np.int64), doc[first], low[first], size[first], np.zeros(first.sum(), bool)))
            yield _arrow((blocks.mix(d.astype(np.uint64) + l.astype(np.uint64)).view(np.int64), np.zeros(len(d), np.int64), d, l, s, np.ones(len(d), bool)))

    def _arrow(columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(k)) for x, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, "key bigint, hash bigint, id bigint, low int, size int, sure boolean")


def compare_strings(strings: DataFrame) -> DataFrame:
    """``key, id, low, size``: with a null key, places that repeat an earlier one; else the first place
    of each of a key's different strings, where there are several.

    Streams over sorted partitions, remembering the first string of the last key and the last different one.
    """
    names, kinds = ["key", "id", "low", "size"], ["i8", "i8", "i4", "i4"]

    @blocks.tidy
    def run(batches):
        held = None  # rows to set before the next batch, and which of them have been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            sure = batch.column(5).to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy() for i in range(5)]
            yield _arrow(None, *(c[sure] for c in columns[2:]))
            columns = [c[~sure] for c in columns]
            given = np.zeros(len(columns[0]), bool)
            if not len(given):
                continue
            if held:
                columns = [np.concatenate(x) for x in zip(held[0], columns)]
                given = np.concatenate([held[1], given])
            key, hash_, doc, low, size = columns
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], hash_[1:] != hash_[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (low != low[lead])
            yield _arrow(None, doc[later], low[later], size[later])
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, new)[group] > 1
            ask = new & several & ~given
            yield _arrow(key[ask], doc[ask], low[ask], size[ask])
            keep = [np.flatnonzero(new_key)[-1], np.flatnonzero(new)[-1]]
            keep = keep[:1] if keep[0] == keep[1] else keep
            held = [c[keep] for c in columns], several[keep]

    def _arrow(key, *rest):
        key = pa.nulls(len(rest[0]), pa.int64()) if key is None else pa.array(key.astype("i8"))
        return pa.RecordBatch.from_arrays([key, *(pa.array(x.astype(k)) for x, k in zip(rest, kinds[1:]))], names)

    dealt = strings.repartition(blocks.parts(strings), "key").sortWithinPartitions("key", "hash", "id", "low")
    return dealt.mapInArrow(run, "key bigint, id bigint, low int, size int")


def fetched(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, id, low, content, hot`` of every asked place."""
    places = asked.groupBy("id").agg(F.collect_list(F.struct("key", "low", "size", "hot")).alias("places"))

    @blocks.tidy
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                out += [(p["key"], doc, p["low"], raw[p["low"]: p["low"] + p["size"]], p["hot"]) for p in places]
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def _rows(out):
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], ["key", "id", "low", "content", "hot"])

    return docs.join(places, "id").mapInArrow(run, "key bigint, id bigint, low int, content binary, hot boolean")


def sorted_shards(strings: DataFrame, length: int) -> DataFrame:
    """``id, low, size``: repeats found by suffix arrays over shards of whole keys."""

    def found(held):
        if len(held) < 2:
            return None
        doc, start = repeated_windows([h[3] for h in held], np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), length)
        d, l, s = _merged(doc, start, np.full(len(doc), length))
        return pa.RecordBatch.from_arrays([pa.array(d.astype("i8")), pa.array(l.astype("i4")), pa.array(s.astype("i4"))], ["id", "low", "size"])

    @blocks.tidy
    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= SHARD and row[0] != last:
                    out = found(held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        out = found(held)
        if out is not None:
            yield out

    dealt = strings.select("key", "id", "low", "content").repartition(blocks.parts(strings), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id bigint, low int, size int")


def hashed_windows(strings: DataFrame, length: int) -> DataFrame:
    """``id, low, size``: the same for keys with too many strings, window by window."""

    @blocks.tidy
    def run(batches):
        for batch in batches:
            buf, offs = blocks.flat(batch.column(3))
            n = np.maximum(np.diff(offs) - length + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            where = offs[row] + at
            first, second = blocks.span_hash(buf, where, where + length), batch.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(second), pa.array(first.view(np.int64)), pa.array(batch.column(1).to_numpy()[row]),
                 pa.array((batch.column(2).to_numpy()[row] + at).astype("i4"))], ["key", "hash", "id", "low"])

    windows = strings.select("key", "id", "low", "content").mapInArrow(run, "key bigint, hash bigint, id bigint, low int")
    earliest = windows.groupBy("key", "hash").agg(F.min(F.struct("id", "low")).alias("first"))
    return (windows.join(earliest, ["key", "hash"]).where("first.id < id or first.low < low")
            .select("id", "low", F.lit(length).alias("size")))


def spans(docs: DataFrame, length: int = LENGTH, cap: int = CAP) -> DataFrame:
    """``id, low, size``: spans (they may overlap) of the bytes to remove, for ``docs`` of ``id, text``."""
    compared = settle(compare_strings(strings_of(docs, length)))
    asked = compared.where("key is not null")
    many = asked.groupBy("key").count().where(F.col("count") > cap).select("key", F.lit(True).alias("hot"))
    asked = asked.join(many, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    strings = settle(fetched(docs, asked))
    return (compared.where("key is null").select("id", "low", "size")
            .union(sorted_shards(strings.where("not hot"), length))
            .union(hashed_windows(strings.where("hot"), length)))


def kept(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, cap: int = CAP,
         digests: bool = False) -> DataFrame:
    """Every row with ``kept`` and ``kept_text`` (the remaining bytes, and as text without the
    characters cut in two; ``digests``: their SHA-256 instead, as ``kept_sha256``), ``n_bytes``, ``n_removed``, ``n_spans`` and ``removed`` (list of ``low, size``).

    Without ``digests`` the row keeps its other columns; those of the same names are replaced.
    """
    far = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 2))
    number = F.coalesce(F.col(key).cast("bigint"), far)
    docs = df.select(number.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    removed = settle(spans(docs, length, cap).groupBy("id").agg(F.collect_list(F.struct("low", "size")).alias("places")))
    made = ["n_bytes", "n_removed", "n_spans", "removed", *(["kept_sha256"] if digests else ["kept", "kept_text"])]
    others = [key] if digests else [c for c in df.columns if c not in made and c != text]
    source = (df.select(number.alias("_id"), F.col(text).alias("_text"), F.struct(*(F.col(c) for c in others)).alias("_row"))
              .join(removed.withColumnRenamed("id", "_id"), "_id", "left").select("_text", "places", "_row"))
    span = pa.list_(pa.struct([("low", pa.int32()), ("size", pa.int32())]))

    @blocks.tidy
    def run(batches):
        # A thousand rows at a time: what is made of them is several times their size.
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            total, gone, count, where, left = [], [], [], [], []
            for text_, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text_ or "").encode()
                low, size = (np.array([p[x] for p in places or ()], np.int64) for x in ("low", "size"))
                _, low, size = _merged(np.zeros(len(low), np.int64), low, np.minimum(size, np.maximum(len(raw) - low, 0)))
                low, size = low[size > 0], size[size > 0]
                parts, at = [], 0
                for a, n in zip(low.tolist(), size.tolist()):
                    parts.append(raw[at:a])
                    at = a + n
                rest = b"".join([*parts, raw[at:]])
                total.append(len(raw)), gone.append(len(raw) - len(rest)), count.append(len(low))
                where.append([{"low": a, "size": n} for a, n in zip(low.tolist(), size.tolist())])
                left.append(rest)
            ends = [pa.array([hashlib.sha256(x).hexdigest() for x in left])] if digests else [
                pa.array(left, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(where, span), *ends], ["_row", "_text", *made])

    rest = "n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<low: int, size: int>>"
    ends = "kept_sha256 string" if digests else "kept binary, kept_text string"
    out = source.mapInArrow(run, blocks.shape(source, "_row", f"_text string, {rest}, {ends}"))
    columns = others if digests else [c for c in df.columns if c not in made]
    return out.select(*(F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in columns), *made)


def query(spark, sf_dir: str) -> DataFrame:
    found = kept(blocks.read(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffix_dedup": query}
ORACLES = {"op7_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, x FROM n WHERE n >= 100),
h AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, 200)) AS a, hash('b' || substr(x, 2 * p + 1, 200)) AS b FROM w),
f AS (SELECT a, b, min((doc_id, p)) AS first FROM h GROUP BY a, b HAVING count(*) > 1),
r AS (SELECT h.doc_id, h.p FROM h JOIN f ON h.a = f.a AND h.b = f.b WHERE (h.doc_id, h.p) > f.first),
s AS (SELECT doc_id, p, CASE WHEN p > 100 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM s),
k AS (SELECT doc_id, g, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last FROM k GROUP BY doc_id),
q AS (SELECT k.doc_id, string_agg(substr(n.x, 2 * coalesce(prev, 0) + 1, 2 * (k.lo - coalesce(prev, 0))), '' ORDER BY k.lo) AS x
      FROM (SELECT *, lag(hi) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM k) k JOIN n USING (doc_id) GROUP BY k.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN n.x ELSE coalesce(q.x, '') || substr(n.x, 2 * c.last + 1) END)) AS kept_sha256
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""}
