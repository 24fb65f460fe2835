"""Jaccard join of word shingles through sketches.

Sets are put into size bands. In a band where linked sets differ in at most ``d``
elements, elements are dealt into ``B > d`` blocks by hash, and a set's sketch has the sum of
its elements in each. An element that one of two sets lacks changes one block, so two linked sets
agree in at least ``B - d`` of them, and joining on (band, block number, block) misses no link. Sums are of whole
hashes: sets that share no element agree in no block, however many there are. A set also
enters the band below its own if smaller partners may be there.

Before whole sets are compared, parity sketches of one size for all are: one bit per hash cell, the parity
of the elements there. The Hamming distance of two is at most the size of the sets' symmetric difference.

Two things keep the join selective. Shingles that very many texts share are left out of
the sketches: that cannot enlarge a difference, so the bound holds for whatever list is
left out. And blank blocks are not joined on: a set with fewer than ``B - d`` of them still
agrees with each partner in another block. Sets with more (texts made of common passages)
are looked up by a second sketch of all their elements as well, blank blocks included if
need be, where they meet each other.

Linked sets share at least ``B - d - blanks`` keys. Of its keys that anyone shares, a set
therefore needs only the rarest (all but that number less one, by a common order), and
none at all if it shares fewer: texts that are alike, but not enough, drop out here
instead of being paired.

Equal sets are one class. What is left is settled without pairing groups with themselves:
first every document is compared with the one it meets most often as a key's smallest.
Exact intersections decide. Then, only in keys whose members are still in different
components, the members outside the key's largest component are compared with those of
other components. Every pair that could link is therefore verified or already connected.
A task passes on one row per key; the others of its batch are dealt out by themselves, so
that a hot key sends one row per batch to one place.

Defined results: a text with fewer words than a shingle is one shingle; null, empty and
blank texts have empty sets and link with nothing; rows without an id get no component;
repeated ids share one. Only named columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.links import components

WORDS, SHARE = 4, 85
BAND = 1.5
CELLS = 64
#: A shingle that so many different sets of a batch share may be common; at most so many are left out of sketches.
OFTEN, COMMON = 3, 1_000_000
#: Members of a key that are compared with as many others in one place.
CELL = 2000
CHECK_CELLS = 2048
#: Rows, and about as many bytes of text, whose sets and keys a task holds at a time: keys take several times the room of their texts.
ROWS, BYTES = 2500, 8 << 20
#: The query works its bands off in so many turns, so that about half of the key rows are on disk at a time.
TURNS = 2


class Marks:
    """Which shingles are left out of sketches, by one bit each; a shingle that shares the bit of one goes with it, in every text alike."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, (64 * len(keys)).bit_length())
        self.shift, self.flags = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        place, bit = self._place(keys)
        np.bitwise_or.at(self.flags, place, bit)

    def _place(self, keys):
        at = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place, bit = self._place(keys)
        return self.flags[place] & bit != 0


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    buf = blocks.LOWER[buf]
    s, e, row = blocks.word_spans(buf, offs)
    each = blocks.span_hash(buf, s, e) if len(s) else np.zeros(0, np.uint64)
    factor = blocks.mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = max(len(each) - words + 1, 0)
    whole = np.zeros(n, np.uint64)
    for i in range(words):
        whole += each[i: i + n] * factor[i]
    whole = blocks.mix(whole)
    at = blocks.per_row(row, len(offs) - 1)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            found = np.sort(whole[a: b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            short = (each[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(blocks.mix(short + np.uint64(b - a)))
        else:
            out.append(whole[:0])
    return out


def bands(share: int, most: int) -> list[tuple[int, int, int, int]]:
    """``low, high, d, B`` of every size band up to ``most`` elements; bands where only equal sets link are left out."""
    out, low = [], 1
    factor = max(BAND, 110 / share)
    while low <= most:
        high = max(low + 1, int(low * factor))
        largest = high - 1 + (high - 1) * 100 // share
        d = largest * (100 - share) // (100 + share)
        if d:
            out.append((low, high, d, d + 3 + min(6, d // 8)))
        low = high
    return out


def _dealt(flat: np.ndarray, sets: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set and block number of every element, and where a block's elements begin (hashes ascend, so blocks do)."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    block = ((flat >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    return of, block, np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (of[1:] != of[:-1])])[: len(flat)])


def _blocks_of(sets: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set number, block number and parity word of every block that has elements."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    of, block, first = _dealt(flat, sets, size)
    word = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(CELLS - 1)), first) if len(flat) else flat
    return of[first], block[first].astype(np.int64), word


def _sums_of(sets: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set number, block number and sum of the elements of every block that has some."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    of, block, first = _dealt(flat, sets, size)
    return of[first], block[first].astype(np.int64), np.add.reduceat(flat, first) if len(flat) else flat


def _keys_of(sets, owner, size, low, high, count, kind, share):
    """Owner, key and number of keys shared with a linked set, per block; owners with too many blanks."""
    of, block, word = _sums_of(sets, count)
    of, block, word = of[word != 0], block[word != 0], word[word != 0]
    blank = count - np.bincount(of, minlength=len(sets))
    partner = np.where(size >= high, high - 1, size * 100 // share)
    agree = count - (100 - share) * (size + partner) // (100 + share)
    need = np.maximum(agree - blank, 1)
    return owner[of], _tag(low, count, kind, block, word), need[of], blank >= agree, of, block


def _tag(low, count, kind, block, word):
    place = (block + (low * 1_000_003 + count * 7 + kind)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return blocks.mix(blocks.mix(place + np.uint64(kind)) ^ word * np.uint64(0xD6E8FEB86659FD93))


def sketch_keys(sets: list[np.ndarray], share: int, common: Marks, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, ...]:
    """Set number, join key, ``need`` and lane (one per band and sketch) of every block that a set is looked up by.

    Of several turns, each has every so-manyth band.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    keep = ~common.has(flat)
    at = np.concatenate([[0], np.cumsum(size)])
    rare = [x[keep[a:b]] for x, a, b in zip(sets, at[:-1], at[1:])]
    none = np.zeros(0, np.int64)
    out = [(none, none.astype(np.uint64), none, none)]
    for number, (low, high, d, count) in enumerate(bands(share, int(size.max(initial=0)))):
        if number % turns != turn:
            continue
        # Larger partners of this band's sets come from the band above.
        pick = np.flatnonzero((size >= low) & (size * share <= (high - 1) * 100))
        for kind, of_sets in ((0, rare), (1, sets)):
            if not len(pick):
                break
            owner, key, need, poor, of, block = _keys_of([of_sets[i] for i in pick], pick, size[pick], low, high, count, kind, share)
            lane = np.full(len(key), 2 * number + kind)
            if kind and poor.any():
                lane, need = lane.copy(), np.where(poor[of], 1, need)
                grid = np.ones((len(pick), count), bool)
                grid[of, block] = False
                grid[~poor] = False
                of, block = np.nonzero(grid)
                owner, key = np.append(owner, pick[of]), np.append(key, _tag(low, count, 1, block, np.zeros(len(of), np.uint64)))
                need, lane = np.append(need, np.ones(len(of), np.int64)), np.append(lane, np.full(len(of), 2 * number + 1))
            out.append((owner, key, need, lane))
            pick = pick[poor]
    return tuple(np.concatenate(x) for x in zip(*out))


def _batches(batch, words):
    """Ids of a batch and the shingle sets of its texts."""
    buf, offs = blocks.flat(batch.column(1))
    sets = []
    for a, b in blocks.slices(offs):
        sets += shingle_hashes(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], words)
    return sets


def _portions(batches):
    """Batches in slices of at most ``ROWS`` rows and about ``BYTES`` of text, one row at least."""
    for batch in batches:
        _, offs = blocks.flat(batch.column(1))
        for a, b in blocks.slices(offs, BYTES):
            for at in range(a, b, ROWS):
                yield batch.slice(at, min(ROWS, b - at))


def _often(sets):
    """Shingles that at least ``OFTEN`` of the sets hold, and how many do."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    flat.sort()
    found = np.unique(flat[OFTEN - 1:][flat[OFTEN - 1:] == flat[: max(len(flat) - OFTEN + 1, 0)]])
    return found, np.searchsorted(flat, found, "right") - np.searchsorted(flat, found)


def _identity(sets):
    """Two independent 64-bit sums that tell sets apart."""
    first = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
    second = np.array([blocks.mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for x in sets], np.uint64)
    return first, second


def set_sizes(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``id, n, s1, s2, sketch`` of every row: its set's size, identity and a parity sketch of one size
    for all; and, in rows of their own, ``shingle, times``: what several different sets of a batch share."""
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    @blocks.tidy
    def run(batches):
        for batch in batches:
            sets = _batches(batch, words)
            s1, s2 = _identity(sets)
            _, alone = np.unique(np.stack([s1, s2]), axis=1, return_index=True) if len(sets) else (None, [])
            shingle, times = _often([sets[i] for i in alone])
            none, blank = pa.nulls(len(shingle), pa.int64()), pa.nulls(len(sets), pa.int64())
            sketches = np.zeros((len(sets), CHECK_CELLS // CELLS), np.uint64)
            for a, b in blocks.slices(8 * np.cumsum([0, *map(len, sets)])):  # the arrays take several times the room of the sets
                of, block, word = _blocks_of(sets[a:b], CHECK_CELLS // CELLS)
                sketches[a + of, block] = word
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 _lists(list(sketches)), blank, blank], names)
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(len(shingle), pa.list_(pa.int64())), pa.array(shingle.view(np.int64)), pa.array(times)], names)

    names = ["id", "n", "s1", "s2", "sketch", "shingle", "times"]
    return source.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>, shingle bigint, times bigint")


LONE, LEADS, FOLLOWS = 0, 1, 2
#: A member of a key of one cell that is outside the key's largest component: held against others, and one of them.
BOTH = 2


def key_rows(df: DataFrame, key: str, text: str, words: int, share: int, common: Broadcast, turn: int = 0, turns: int = 1) -> DataFrame:
    """``key, id, need, lane, role``: what each set is looked up by, once per batch and equal set.

    Where several rows of a batch have a key, the smallest id leads.
    """
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    @blocks.tidy
    def run(batches):
        for batch in _portions(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = _batches(batch, words)
            s1, s2 = _identity(sets)
            order = np.lexsort((ids, s2, s1))
            same = np.concatenate([[False], (s1[order][1:] == s1[order][:-1]) & (s2[order][1:] == s2[order][:-1])])[: len(order)]
            alone = order[~same]
            owner, keys, need, lane = sketch_keys([sets[i] for i in alone], share, common.value, turn, turns)
            owner = ids[alone][owner]
            order = np.lexsort((owner, keys))
            keys, owner, need, lane = (x[order] for x in (keys, owner, need, lane))
            first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
            role = np.where(first, np.where(np.append(first[1:], True)[: len(keys)], LONE, LEADS), FOLLOWS)
            for a in range(0, len(keys), 500_000):
                part = slice(a, a + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[part]) for x in (keys.view(np.int64), owner, need.astype("i2"), lane.astype("i2"), role.astype("i1"))],
                    ["key", "id", "need", "lane", "role"])

    return source.mapInArrow(run, "key bigint, id bigint, need smallint, lane smallint, role tinyint")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key, id, need, lane`` of the keys that several rows have; rows that follow in their batch are dealt out by themselves.

    Streams over sorted partitions; of the last key it remembers the first row, and whether that was given out.
    """

    @blocks.tidy
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            follows = columns[4] == FOLLOWS
            out = [[c[follows] for c in columns[:4]]]
            columns = [c[~follows] for c in columns]
            given = np.zeros(len(columns[0]), bool)
            if len(given):
                if held:
                    columns, given = [np.concatenate(x) for x in zip(held[0], columns)], np.append(held[1], given)
                key = columns[0]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(start, len(key)))
                several = np.repeat((size > 1) | np.logical_or.reduceat(columns[4] == LEADS, start), size)
                out.append([c[several & ~given] for c in columns[:4]])
                held = [c[start[-1:]] for c in columns], several[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "id", "need", "lane"])

    deal = F.when(F.col("role") == FOLLOWS, F.xxhash64("key", "id")).otherwise(F.col("key"))
    dealt = rows.repartition(blocks.parts(rows), deal).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, id bigint, need smallint, lane smallint")


def needed(members: DataFrame) -> DataFrame:
    """``key, id``: of each document's shared keys those that a linked partner cannot all avoid, rarest first."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    mine = Window.partitionBy("id", "lane")
    ranked = members.join(sizes, "key").select(
        "key", "id", "need", F.row_number().over(mine.orderBy("size", "key")).alias("rank"), F.count("*").over(mine).alias("n"))
    return ranked.where("rank <= n - need + 1").select("key", "id")


def met(kept: DataFrame) -> DataFrame:
    """``key, id`` of the keys that several documents kept."""
    return kept.join(kept.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "key", "left_semi")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def set_rows(df: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """``id, hashes``: whole sets of the wanted documents."""
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    @blocks.tidy
    def run(batches):
        for batch in _portions(batches):
            sets = _batches(batch, words)
            for a in range(0, len(sets), 1000):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a: a + 1000], _lists(sets[a: a + 1000])], ["id", "hashes"])

    return texts.join(wanted, "id", "left_semi").mapInArrow(run, "id bigint, hashes array<bigint>")


def verified(pairs: DataFrame, sketches: DataFrame, sets_of, share: int) -> DataFrame:
    """Those ``a, b`` whose sets reach the share.

    The distance of the sketches rules most others out; only then are whole sets made
    (``sets_of`` the ids that remain) and intersected. The ids are settled first: while they
    are few, Spark sends them to the texts by itself and no text is shuffled.
    """
    near = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    side = lambda one, of, n: sketches.select(F.col("rep").alias(one), F.col("sketch").alias(of), F.col("n").alias(n))
    close = settle(
        pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
        .where(F.greatest("na", "nb") * share <= F.least("na", "nb") * 100)
        .where(near * (100 + share) <= (F.col("na") + F.col("nb")) * (100 - share)).select("a", "b").distinct())
    sets = settle(sets_of(settle(close.select(F.col("a").alias("id")).union(close.select("b")).distinct())))
    both = (close.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return settle(both.withColumn("i", shared).where(100 * F.col("i") >= share * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b"))


def placed_in_cells(members: DataFrame) -> DataFrame:
    """``members`` with their key's largest component (``main``) and the cells its members are dealt into."""
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    counts = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    chunks = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    counts = counts.select("key", "main", chunks(F.col("all")).alias("across"), chunks(F.col("all") - F.col("most")).alias("down"))
    return members.join(counts, "key")


def close_pairs(placed: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """``a, b``: members of one key (placed in cells) but of different components whose sketches are close enough to link.

    Members outside a key's largest component are held against the others of the key. The
    comparison is made in cells of at most about ``CELL`` by ``CELL`` members, into which larger
    keys are dealt, and only close pairs leave it. A key of one cell sends each member once: those of
    the largest component come first, each of the others is held against all before it.
    """
    rows = placed.join(sketches, "rep")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    what = ["rep", "component", "n", "sketch"]
    others = rows.select("key", upto(F.col("down")).alias("i"), place(F.col("across")).alias("j"),
                         F.when((F.col("across") == 1) & (F.col("component") != F.col("main")), BOTH).otherwise(0).alias("kind"), "main", *what)
    aside = (rows.where("component <> main and across > 1")
             .select("key", place(F.col("down")).alias("i"), upto(F.col("across")).alias("j"), F.lit(1).alias("kind"), "main", *what))

    @blocks.tidy
    def run(batches):
        at, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, kind, main, rep, component, n = (batch.column(c).to_numpy() for c in range(8))
            sketch = batch.column(8).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (kind[1:] != kind[:-1])])
            cut, out = np.flatnonzero(new), [[], []]
            for a, b in zip(cut, np.append(cut[1:], len(key))):
                if (key[a], i[a], j[a]) != at:
                    at, held, ready = (key[a], i[a], j[a]), [], None
                if kind[a] != 1:
                    held.append((rep[a:b], component[a:b], n[a:b], sketch[a:b]))
                    ready = None
                if kind[a] == 0:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held)] if held else None
                if ready is None:
                    continue
                for r in range(a, b):
                    if kind[a] == BOTH:
                        before = slice(0, len(ready[0]) - (b - r))
                        other = ready[1][before] != component[r]
                    else:
                        before = slice(None)
                        other = (ready[1] != component[r]) & ((ready[1] == main[r]) | (ready[0] > rep[r]))
                    other &= (np.maximum(ready[2][before], n[r]) * share <= np.minimum(ready[2][before], n[r]) * 100)
                    other = np.flatnonzero(other)
                    if not len(other):
                        continue
                    apart = np.bitwise_count(ready[3][other] ^ sketch[r]).sum(axis=1, dtype=np.int64)
                    other = other[apart * (100 + share) <= (ready[2][other] + n[r]) * (100 - share)]
                    out[0].append(np.minimum(ready[0][other], rep[r])), out[1].append(np.maximum(ready[0][other], rep[r]))
            if out[0]:
                pair = np.unique(np.stack([np.concatenate(x) for x in out]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    dealt = others.union(aside).repartition(blocks.parts(placed), "key", "i", "j").sortWithinPartitions("key", "i", "j", "kind")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE, turns: int = 1) -> DataFrame:
    """Per row: the key, ``n_shingles`` and ``component_id``.

    Bands are worked off in ``turns``, and so are the keys whose members are compared: more of them keep fewer
    keys and sketches on disk at a time, and make the sets again each.
    """
    seen = settle(set_sizes(df, key, text, words))
    common = (seen.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
              .orderBy(F.desc("times"), "shingle").limit(COMMON).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))
    rows = seen.where("shingle is null")
    classes = rows.where("id is not null and n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    rows = settle(rows.join(classes, ["s1", "s2", "n"], "left")
                  .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    rep = rows.where("id is not null").select("id", "rep").distinct()

    kept = []
    sent = df.sparkSession.sparkContext.broadcast(Marks(common))
    for turn in range(turns):
        found = settle(shared_keys(key_rows(df, key, text, words, share, sent, turn, turns)))
        kept.append(settle(needed(found)))
        blocks.discard(found)
    sent.unpersist()
    members = settle(met(reduce(DataFrame.union, kept)).join(rep, "id").select("key", "rep").distinct())
    for part in kept:
        blocks.discard(part)
    leads = members.groupBy("key").agg(F.min("rep").alias("lead"))
    stars = (members.join(leads, "key").where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
             .groupBy("rep").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead")))
    stars = settle(stars.select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    sketches = seen.where("shingle is null and id is not null and n > 0").select(F.col("id").alias("rep"), "n", "sketch")

    def sets_of(ids):
        return set_rows(df, key, text, words, ids)

    links = verified(stars, sketches, sets_of, share)
    found = components(links).toDF("rep", "component")
    placed = settle(members.join(found, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ = settle(placed.join(split, "key", "left_semi"))
    blocks.discard(placed)
    blocks.discard(members)
    close = []
    for turn in range(turns):
        # Written by itself: what the last turn shuffled is let go of only by the second write after it.
        cells = settle(placed_in_cells(open_.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == turn)))
        close.append(settle(close_pairs(cells, sketches, share)))
        blocks.discard(cells)
    blocks.discard(open_)
    pairs = reduce(DataFrame.union, close).distinct().join(stars, ["a", "b"], "left_anti")
    links = links.union(verified(pairs, sketches, sets_of, share))

    final = components(links).toDF("rep", "component_id")
    return rows.join(final, "rep", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(blocks.read(spark, sf_dir, "documents"), turns=TURNS)


QUERIES = {"op4_jaccard_join": query}
ORACLES = {"op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i+3], ' ')))) END AS s
  FROM w),
o AS (SELECT doc_id, list_sort(s) AS o FROM s WHERE len(s) > 0),
c AS (SELECT min(doc_id) AS rep, o AS s, len(o) AS n FROM o GROUP BY o),
e AS (SELECT rep, n, unnest(s) AS h FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN k ON k.node = c.rep
"""}
