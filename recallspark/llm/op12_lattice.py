"""Scoring of texts by a subword lattice: the probability of a text over all its segmentations.

The arcs of a word's lattice are the pieces of an existing vocabulary that stand at each of its
bytes, a byte of its own among them, so every text has a path. The vocabulary gives each piece
a score (its rank); turned into weights by Zipf's law these weight all segmentations. Training
texts then move the weights: forward and backward sums over every training word give the
expected number of uses of each piece, which are added to the scores' share. A forward
recursion in log space over the final weights gives the marginal probability of each word. No
piece crosses a word, so a text's probability is the product over its words and its end.

A word that training texts hold is also an arc of its own lattice, from start to end, and
carries the word's share of the training tokens; the pieces carry the rest, which is the share
of training tokens that occur once (what is still unseen is estimated by what was seen once).
So what is gathered grows with the corpus: the counts of all words.

Words are counted and weighed once each, as a table. The most frequent ones (``HOT``, some
four megabytes) go with the tasks that read the texts; all other words of a text meet the
table in a join.

Defined results: null and empty texts have no words, only an end; a null id is a training
document; repeated rows count and are scored again; a word of any length is one lattice. Only
the named columns are read, so further columns cannot clash. Without training documents all
counts are zero and the vocabulary's own scores weigh. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle

VOCABULARY = "piece_bpe_32k.model"
#: Documents with this remainder are held out.
FOLDS, HELD = 7, 2
#: Pieces that the vocabulary's own scores count for, beside the expected uses in training texts.
STRENGTH = 10_000.0
#: Times the expected uses are found anew with the weights that the last ones gave.
ROUNDS = 2
#: Words that every task holds; the rest is joined.
HOT = 1 << 17
_SIEVE = 20


def scored_pieces(file: bytes) -> list[tuple[bytes, float]]:
    """Each usable piece's bytes and its score; single bytes come after all others.

    Pieces that no lower-cased word can hold (upper-case letters, white space inside) are left out.
    """
    library = sentencepiece.SentencePieceProcessor(model_proto=file)
    found: dict[bytes, float] = {}
    last = min(library.get_score(i) for i in range(library.get_piece_size()) if not library.is_unused(i))
    for i in range(library.get_piece_size()):
        if library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
            continue
        piece = library.id_to_piece(i)
        raw, score = (bytes([int(piece[1:-1], 16)]), last - 1) if library.is_byte(i) else (piece.replace("▁", " ").encode(), library.get_score(i))
        if not any(0x41 <= b <= 0x5A for b in raw) and not any(blocks.SPACE[b] for b in raw[1:]):
            found[raw] = max(score, found.get(raw, score))
    return sorted(found.items())


class Lattice:
    """All pieces of a vocabulary at all places of words that are laid end to end."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        self.strings = [p for p, _ in pieces]
        zipf = 1.0 / (1.0 - np.array([s for _, s in pieces]))
        self.prior = zipf / zipf.sum()
        flat = np.frombuffer(b"".join(self.strings), np.uint8)
        length = np.array([len(s) for s in self.strings])
        ends = np.cumsum(length)
        hashes = blocks.span_hash(flat, ends - length, ends)
        self.tables = {}
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            order = np.argsort(hashes[mine])
            self.tables[n] = hashes[mine][order], mine[order]
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[hashes >> np.uint64(64 - _SIEVE)] = True

    def arcs(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every arc."""
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
        starts, ends, pieces = [], [], []
        at = np.arange(len(buf))
        for n, (hashes, ids) in self.tables.items():
            at = at[left[at] >= n]
            if not len(at):
                break
            key = self._hash(buf, at, n)
            near = self.sieve[key >> np.uint64(64 - _SIEVE)]
            start, key = at[near], key[near]
            place = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            hit = hashes[place] == key
            starts.append(start[hit])
            ends.append(start[hit] + n)
            pieces.append(ids[place[hit]])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))

    def _hash(self, buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            self._buf, self._total = buf, np.append(np.uint64(0), np.cumsum(blocks._BYTE[buf] * blocks._power("up", len(buf))))
            self._down = blocks._power("down", len(buf) + 1)
        value = (self._total[at + n] - self._total[at]) * self._down[at]
        return blocks.mix(value + np.full(1, n, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sweep(into: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, layer: np.ndarray) -> None:
    """Log-sum of all arcs into each target, layer by layer: what a layer needs is done before it."""
    order = np.lexsort((target, layer))
    source, target, weight, layer = source[order], target[order], weight[order], layer[order]
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(layer) != 0)), len(layer)) if len(layer) else []
    for x, y in zip(bounds[:-1], bounds[1:]):
        first = np.flatnonzero(np.append(True, np.diff(target[x:y]) != 0))
        into[target[x:y][first]] = np.logaddexp.reduceat(into[source[x:y]] + weight[x:y], first)


def forward(offs: np.ndarray, arcs: tuple, weight: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all paths from its word's start to each place.

    A place is a byte offset plus the word's number, so that a word's end is not the next one's start.
    """
    start, end, piece = arcs
    word = np.searchsorted(offs, start, "right") - 1
    alpha = np.full(offs[-1] + len(offs), -np.inf)
    alpha[offs[:-1] + np.arange(len(offs) - 1)] = 0.0
    _sweep(alpha, start + word, end + word, weight[piece], end - offs[word])
    return alpha


def expected(offs: np.ndarray, arcs: tuple, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is used in words that occur so many times, over all their segmentations."""
    start, end, piece = arcs
    word = np.searchsorted(offs, start, "right") - 1
    alpha = forward(offs, arcs, weight)
    ends = offs[1:] + np.arange(len(offs) - 1)
    beta = np.full(len(alpha), -np.inf)
    beta[ends] = 0.0
    _sweep(beta, end + word, start + word, weight[piece], offs[word + 1] - start)
    share = np.exp(alpha[start + word] + weight[piece] + beta[end + word] - alpha[ends][word])
    return np.bincount(piece, share * times[word], minlength=len(weight))


@functools.lru_cache(2)
def lattice(file: bytes) -> Lattice:
    return Lattice(scored_pieces(file))


def vocabulary_file(path: str | None = None) -> bytes:
    """The vocabulary as bytes, read by the driver once (half a megabyte) and sent along with the tasks."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a slice, and the index and row of every occurrence."""
    buf = blocks.LOWER[buf]
    start, end, row = blocks.word_spans(buf, offs)
    at = np.append(0, np.cumsum(end - start)).astype(np.int64)
    inside = ~blocks.SPACE[buf]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buf[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), row


def counts(source: DataFrame) -> DataFrame:
    """``word, c``: every word of all texts, and its occurrences in training texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            buf, offs = blocks.flat(batch.column("text"))
            for x, y in blocks.slices(offs):
                names, word, row = _words(buf[offs[x]: offs[y]], offs[x: y + 1] - offs[x])
                c = np.bincount(word, weights=train[x:y][row], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(c)], ["word", "c"])

    return source.select("held_out", "text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _laid_out(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of words, each with a space before it, as flat bytes and offsets."""
    buf, offs = blocks.flat(column)
    for x, y in blocks.slices(offs, blocks.SLICE // 4):
        n = y - x
        part, at = buf[offs[x]: offs[y]], offs[x: y + 1] - offs[x] + np.arange(n + 1)
        spaced = np.full(len(part) + n, 0x20, np.uint8)
        spaced[np.arange(len(part)) + np.repeat(np.arange(1, n + 1), np.diff(offs[x: y + 1]))] = part
        yield x, y, spaced, at


def piece_weights(words: DataFrame, file: bytes, strength: float = STRENGTH, rounds: int = ROUNDS) -> np.ndarray:
    """Log weight of every piece, in the order of :func:`scored_pieces`.

    One row per piece comes back from each round's grouped sums. Weights are rounded to nine places,
    so that the order of a sum does not show.
    """
    prior = lattice(file).prior
    weight = np.log(prior)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], weight=weight):
            mine, total = lattice(file), np.zeros(len(weight))
            for batch in batches:
                times = batch.column("c").to_numpy()
                for x, y, buf, offs in _laid_out(batch.column("word")):
                    total += expected(offs, mine.arcs(buf, offs), weight, times[x:y])
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["piece", "used"])

        got = words.where("c > 0").mapInArrow(run, "piece bigint, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        used = np.zeros(len(prior))
        used[got["piece"].to_numpy()] = got["used"].to_numpy()
        weight = np.round(np.log((used + strength * prior) / (used.sum() + strength)), 9)
    return weight


def weighed(words: DataFrame, weight: np.ndarray, file: bytes, total: int, open_share: float, end: float) -> DataFrame:
    """``word, c, score``: the log10 marginal probability of each word over its lattice.

    A token is the end with probability ``end``. Else the word's own arc carries its share of the
    ``total`` training words, and the pieces ``open_share``; a word's first piece begins with a space
    and no other does, so both are distributions over words.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        mine = lattice(file)
        for batch in batches:
            c = batch.column("c").to_numpy()
            for x, y, buf, offs in _laid_out(batch.column("word")):
                alpha = forward(offs, mine.arcs(buf, offs), weight)
                spelled = alpha[offs[1:] + np.arange(y - x)] + np.log(open_share)
                with np.errstate(divide="ignore"):
                    own = np.log(c[x:y] * ((1.0 - open_share) / max(total, 1)))
                score = (np.logaddexp(spelled, own) + np.log1p(-end)) / np.log(10.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(c[x:y]), pa.array(score)], ["word", "c", "score"])

    return words.select("word", "c").mapInArrow(run, "word string, c bigint, score double")


def scored(source: DataFrame, table: DataFrame, size: int, hot: int) -> DataFrame:
    """Per row of ``id, held_out, text``: ``n_words, n_known, base, score`` summed over its words.

    ``size`` is what a count plus one is divided by in the base score.
    """
    near = table.orderBy(F.desc("c"), "word").limit(hot).toArrow()
    names = near["word"].combine_chunks().cast(pa.large_string())
    c, score = near["c"].to_numpy(), near["score"].to_numpy()
    base = np.log10((c + 1) / size)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            buf, offs = blocks.flat(batch.column("text"))
            for x, y in blocks.slices(offs):
                n = y - x
                words, word, row = _words(buf[offs[x]: offs[y]], offs[x: y + 1] - offs[x])
                place = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
                at = place[word]
                hit = at >= 0
                sums = [np.bincount(row, minlength=n)]
                for value in (c > 0, base, score):
                    sums.append(np.bincount(row[hit], weights=value[at[hit]].astype(float), minlength=n))
                key, times = np.unique(row[~hit] * len(words) + word[~hit], return_counts=True)
                holder, other = np.divmod(key, max(len(words), 1))
                bounds = pa.array(blocks.per_row(holder, n).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(x, n), batch.column("held_out").slice(x, n), *(pa.array(s.astype(np.int64)) for s in sums[:2]),
                     *(pa.array(s) for s in sums[2:]), pa.ListArray.from_arrays(bounds, words.take(pa.array(other)).cast(pa.string())),
                     pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))],
                    ["id", "held_out", "n_words", "n_known", "base", "score", "others", "times"])

    made = blocks.shape(source, "id", "held_out boolean, n_words bigint, n_known bigint, base double, score double, others array<string>, times array<int>")
    rows = settle(source.mapInArrow(run, made).withColumn("row_id", F.monotonically_increasing_id()))
    rest = rows.select("row_id", F.inline(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("times"))))
    exact = "decimal(30,12)"  # sums that do not depend on the order of their terms
    met = rest.join(table, "word").groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum((F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(size)))).cast(exact)).alias("more_base"),
        F.sum((F.col("times") * F.col("score")).cast(exact)).alias("more_score"))
    none = F.lit(0)
    return rows.join(met, "row_id", "left").select(
        "id", "held_out", "n_words", (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", none).cast("double")).alias("base"),
        (F.col("score") + F.coalesce("more_score", none).cast("double")).alias("score"))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", file: bytes | None = None, hot: int = HOT,
          strength: float = STRENGTH, rounds: int = ROUNDS) -> DataFrame:
    """Per text: the key, ``held_out``, ``n_tokens, n_known, train_tokens``, ``base_score`` and ``score``."""
    file = file or vocabulary_file()
    source = df.select(F.col(key).alias("id"), (blocks.remainder(F.col(key), FOLDS) == HELD).alias("held_out"), F.col(text).alias("text"))
    words = settle(counts(source))
    ends = source.where("not held_out").count()
    tokens, kinds, once = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1))).first()
    total, kinds = tokens + ends, kinds + (ends > 0)
    size = total + kinds + 1
    weight = piece_weights(words, file, strength, rounds)
    end = (ends + 1.0) / (total + 2.0)
    open_share = (once + 1.0) / (tokens + 2.0) if tokens else 1.0
    table = settle(weighed(words, weight, file, tokens, open_share, end))
    rows = scored(source, table, size, hot)
    return rows.select(
        F.col("id").alias(key), "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + F.lit(float(np.log10((ends + 1) / size)))).alias("base_score"),
        (F.col("score") + F.lit(float(np.log10(end)))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(blocks.read(spark, sf_dir, "documents"))


QUERIES = {"op12_lattice": query}
ORACLES: dict[str, str] = {}
