"""Toxicity behind disguises: restore words by a noisy channel, then score what was meant.

A word made of plain letters has one reading. A word with digits or symbols among its
letters, with runs of a repeated letter, or spelled out letter by letter opens a lattice
of readings: leet symbols stand for letters, separators and repeats may be dropped, each
at the price of that disguise. Viterbi decoding under a character trigram model, counted
over the whole corpus, picks the cheapest reading. Each different disguise is decoded once
per task and remembered. Among lone letters a space may also be the end of a word: besides
the run as one word, all words count that lie on a reading of the run at most ``MARGIN``
bits above its cheapest one.

Restored words and their first bytes (for inflected words) are the features. Their weights
are smoothed log-odds of document presence between toxic and other labelled rows; a
document's evidence is its heaviest word plus the logarithm of how many heavy words it has;
a monotone step function over a bounded histogram of evidence turns that into a probability.

The classifier is fitted on at most ``max_labelled`` labelled rows (smallest hash of the id
first), so the labels sent to the scan have a proven size; the character model and the
scoring cover all texts, whole.

Defined results: null and empty texts score as documents without evidence; null ids count as
remainder 0; an id labelled twice is toxic if one label says so; null labels are ignored;
without toxic labels every score is 0. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.llm import blocks
from recallspark.llm.op2_langid import Lookup

MAX_LABELLED = 60_000
MAX_FEATURES = 50_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
HEAVY = 2.0
STEP, BINS = 0.25, 80
REMEMBERED = 200_000
#: Bytes of texts whose words are found together, and features that a task counts together: some 20 MB of arrays each.
TOGETHER, COUNTED = 1 << 18, 1_000_000
#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Bits: reading a symbol as a letter, dropping it, dropping a separator, a repeat in a pair, in a longer run.
SUBSTITUTE, DROP_SYMBOL, DROP_SEPARATOR, DROP_PAIR, DROP_RUN = 2.0, 14.0, 1.0, 6.0, 1.0
#: How many lone letters in a row open a lattice; at this number one of them must be no digit.
SPELLED = 3
#: Bits that a division of lone letters may lie above the cheapest; letters of a divided word; letters divided at a time.
MARGIN, LONGEST, WINDOW = 22.0, 32, 512

_SYMBOLS = 28  # the end of a word, a to z, any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = 27
_LETTER = _CLASS > 0
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True


def letter_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n``: trigrams of letter classes over all texts, lower-cased."""

    @blocks.tidy
    def run(batches):
        total = np.zeros(_SYMBOLS ** 3, np.int64)
        for batch in batches:
            buf, offs = blocks.flat(batch.column(0))
            for a, b in blocks.slices(offs, TOGETHER):
                c = _CLASS[blocks.LOWER[buf[offs[a]: offs[b]]]]
                c = np.concatenate([[0, 0], c, [0]])
                total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    return df.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Bits of each letter class after the two before it; at most 28 x 28 x 28 numbers."""
    got = letter_counts(df, text).toArrow()
    tri = np.zeros(_SYMBOLS ** 3)
    tri[got["gram"].to_numpy()] = got["n"].to_numpy()
    tri = tri.reshape((_SYMBOLS,) * 3)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + _SYMBOLS)
    bi = (tri.sum(0) + 5 * uni) / (tri.sum((0, 1))[:, None] + 5)
    return -np.log2((tri + 5 * bi[None]) / (tri.sum(2)[:, :, None] + 5))


class Decoder:
    """Viterbi over the readings of one disguised word, under the letter model."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tolist()
        self.known: dict[bytes, bytes] = {}
        self.divided: dict[bytes, list[bytes]] = {}

    def restore(self, word: bytes) -> bytes:
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known[word] = self._viterbi(word.decode("utf-8", "replace"))
        return self.known[word]

    def spelled(self, letters: list[bytes]) -> list[bytes]:
        """What lone letters in a row may mean: one word, and the words of their likely divisions."""
        run = b" ".join(letters)
        if run not in self.divided:
            if len(self.divided) > REMEMBERED // 10:
                self.divided = {}
            chars, found = [x.decode("utf-8", "replace") for x in letters], {self.restore(run)}
            for at in range(0, max(1, len(chars) - LONGEST), WINDOW - LONGEST):
                found |= self._divisions(chars[at: at + WINDOW])
            self.divided[run] = sorted(found)
        return self.divided[run]

    def _divisions(self, chars: list[str]) -> set[bytes]:
        """Words of at least two letters on divisions within ``MARGIN`` of the cheapest."""
        bits, n, found = self.bits, len(chars), []
        for start in range(n):
            states, joined = {(0, 0): (0.0, "")}, 0.0
            for end in range(start, min(n, start + LONGEST)):
                readings = [(c, SUBSTITUTE) for c in LEET.get(chars[end], "")] or [(chars[end], 0.0)]
                following: dict = {}
                for (a, b), (cost, word) in states.items():
                    for read, price in readings:
                        c = ord(read) - 96 if "a" <= read <= "z" else 27
                        new = cost + price + joined + bits[a][b][c]
                        if (b, c) not in following or new < following[b, c][0]:
                            following[b, c] = new, word + read
                states, joined = following, DROP_SEPARATOR
                cost, word = min((cost + bits[a][b][0], word) for (a, b), (cost, word) in states.items())
                found.append((start, end + 1, cost, word))
        before, after = [0.0] + [np.inf] * n, [np.inf] * n + [0.0]
        for start, end, cost, _ in found:
            before[end] = min(before[end], before[start] + cost)
        for start, end, cost, _ in reversed(found):
            after[start] = min(after[start], cost + after[end])
        return {word.encode() for start, end, cost, word in found if end - start > 1 and before[start] + cost + after[end] <= before[n] + MARGIN}

    def _viterbi(self, word: str) -> bytes:
        # A state is the last two classes and the last letter; it holds its cost and a linked reading.
        bits, states, before = self.bits, {(0, 0, ""): (0.0, None)}, ""
        run, pairs = 0, sum(a == b for a, b in zip(word, word[1:]))
        for at, char in enumerate(word):
            run = run + 1 if char == before else 1
            longer = run > 2 or (run == 2 and word[at + 1: at + 2] == char)
            before = char
            letter = char.isalpha()
            readings = [(char, 0.0)] if letter else [(c, SUBSTITUTE) for c in LEET.get(char, "")]
            if not letter:
                readings.append(("", DROP_SYMBOL if char in LEET else DROP_SEPARATOR))
            elif longer or run > 1 and pairs > 1:
                readings.append(("", DROP_RUN if longer else DROP_PAIR))
            following: dict = {}
            for (a, b, last), (cost, path) in states.items():
                for read, price in readings:
                    if read:
                        c = ord(read) - 96 if "a" <= read <= "z" else 27
                        key, new = (b, c, read), (cost + price + bits[a][b][c], (path, read))
                    elif letter and last != char:
                        continue  # a repeat is dropped only after its letter
                    else:
                        key, new = (a, b, last), (cost + price, path)
                    if key not in following or new[0] < following[key][0]:
                        following[key] = new
            states = following or states
        _, path = min(((cost + bits[a][b][0], path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, read = path
            out.append(read)
        return "".join(reversed(out)).encode()


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return total[end] - total[start]


def words(buf: np.ndarray, offs: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words as meant: a byte array (the plain ones in place, restored ones appended), starts, ends and rows."""
    buf = blocks.LOWER[buf]
    s, e, row = blocks.word_spans(buf, offs)
    none = np.zeros(0, np.int64)
    if not len(s):
        return buf, none, none, none
    solid = _LETTER[buf] | _DIGIT[buf]
    place = np.arange(len(buf) + 1)
    bounds = np.empty(2 * len(s), np.int64)
    bounds[::2], bounds[1::2] = s, e
    cs = np.minimum.reduceat(np.append(np.where(solid, place[:-1], len(buf)), len(buf)), bounds)[::2]
    ce = np.maximum.reduceat(np.append(np.where(solid, place[1:], 0), 0), bounds)[::2]
    good = cs < ce
    before = np.where(good & (cs - s == 1), buf[np.maximum(cs - 1, 0)], 0)
    after = np.where(good & (e - ce == 1), buf[np.minimum(ce, len(buf) - 1)], 0)
    lead, tail = np.isin(before, (0x24, 0x40, 0x21, 0x7C)), np.isin(after, (0x24, 0x40))
    s2, e2 = np.where(lead, cs - 1, cs), np.where(tail, ce + 1, ce)
    s2, e2, lone_row = s2[good], e2[good], row[good]
    if not len(s2):
        return buf, none, none, none
    letters = _within(_LETTER[buf], s2, e2)
    same = np.zeros(len(buf), bool)
    same[1:] = (buf[1:] == buf[:-1]) & _LETTER[buf[1:]] & (buf[1:] < 0x80)
    third = np.zeros(len(buf), bool)
    third[2:] = same[2:] & same[1:-1]
    odd = (letters > 0) & (letters < e2 - s2)
    odd |= (_within(third, np.minimum(s2 + 2, e2), e2) > 0) | (_within(same, s2 + 1, e2) >= 2)
    # Apostrophes and single hyphens between letters are ordinary spelling.
    plainly = np.isin(buf, (0x27, 0x2D))
    odd &= ~((letters + _within(plainly, s2, e2) == e2 - s2) & (_within(plainly, s2, e2) == 1) & (_within(same, s2, e2) < 2))
    # Lone letters in a row, one to a word.
    width = np.where(buf[s2] < 0x80, 1, np.where(buf[s2] < 0xE0, 2, 3))
    lone = (e2 - s2 == width) & (_LETTER[buf[s2]] | _LEET[buf[s2]])
    edge = np.flatnonzero(np.concatenate([[True], (lone[1:] != lone[:-1]) | (lone_row[1:] != lone_row[:-1])]))
    size = np.diff(np.append(edge, len(lone)))
    spelled = lone[edge] & (size >= SPELLED) & ((size > SPELLED) | (np.add.reduceat(_LETTER[buf[s2]].astype(np.int64), edge) > 0))
    extra, extra_row = [], []
    for at, n in zip(edge[spelled], size[spelled]):
        found = decoder.spelled([buf[a:b].tobytes() for a, b in zip(s2[at: at + n], e2[at: at + n])])
        extra += found
        extra_row += [lone_row[at]] * len(found)
    for at in np.flatnonzero(odd):
        extra.append(decoder.restore(buf[s2[at]: e2[at]].tobytes()))
        extra_row.append(lone_row[at])
    if not extra:
        return buf, s2, e2, lone_row
    length = np.fromiter(map(len, extra), np.int64, len(extra))
    ends = len(buf) + np.cumsum(length)
    all_rows = np.concatenate([lone_row, np.array(extra_row)])
    order = np.argsort(all_rows, kind="stable")
    return (np.concatenate([buf, np.frombuffer(b"".join(extra), np.uint8)]),
            np.concatenate([s2, ends - length])[order], np.concatenate([e2, ends])[order], all_rows[order])


def features(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Keys of each word: itself and its first bytes (0 where the word is not longer)."""
    out = [blocks.span_hash(buf, s, e)]
    for n in PREFIXES:
        to = np.minimum(s + n, e)
        out.append(np.where(e - s > n, blocks.span_hash(buf, s, to) ^ np.uint64(n), np.uint64(0)))
    return out


def feature_counts(df: DataFrame, text: str, toxic: str, bits: np.ndarray) -> DataFrame:
    """``key, pos, neg``: rows with each feature, by label."""

    @blocks.tidy
    def run(batches):
        decoder, found, size = Decoder(bits), [], 0
        for batch in batches:
            buf, offs = blocks.flat(batch.column(0))
            y = np.array(batch.column(1).to_pylist(), np.int32)
            for a, b in blocks.slices(offs, TOGETHER):
                flat, s, e, row = words(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], decoder)
                for key in features(flat, s, e):
                    order = np.lexsort((key, row))
                    k, r = key[order], row[order]
                    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, bool)
                    new &= k != 0
                    found.append((k[new], y[a:b][r[new]], np.ones(new.sum(), np.int8)))
                    size += len(found[-1][0])
                    if size > COUNTED:
                        found = [summed(found)]
                        size = len(found[0][0])
                        if size > COUNTED // 2:
                            yield as_batch(*found[0])
                            found, size = [], 0
        if found:
            yield as_batch(*summed(found))

    def summed(found):
        key, pos, n = (np.concatenate(x) for x in zip(*found))
        unique, inverse = np.unique(key, return_inverse=True)
        return unique, np.bincount(inverse, pos, len(unique)), np.bincount(inverse, n, len(unique))

    def as_batch(key, pos, n):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key.view(np.int64), pos, n - pos)], ["key", "pos", "neg"])

    return (df.select(text, F.col(toxic).cast("int").alias("y")).mapInArrow(run, "key bigint, pos bigint, neg bigint")
            .groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


class Model:
    """Weights of features, and probabilities of evidence steps."""

    def __init__(self, bits: np.ndarray, keys: np.ndarray, weights: np.ndarray):
        self.bits, self.lookup, self.weights = bits, Lookup(keys), np.append(weights, 0.0)
        self.step = np.zeros(BINS)

    def evidence(self, buf: np.ndarray, offs: np.ndarray, decoder: Decoder) -> np.ndarray:
        flat, s, e, row = words(buf, offs, decoder)
        out, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        if not len(s):
            return out
        keys = features(flat, s, e)
        weight = np.max([self.weights[self.lookup.find(k)] for k in keys], axis=0)
        heavy = np.flatnonzero(weight >= HEAVY)
        order = heavy[np.lexsort((keys[0][heavy], row[heavy]))]
        k, r = keys[0][order], row[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, bool)
        np.maximum.at(out, r, weight[order])
        np.add.at(n, r[new], 1)
        return out + np.log1p(n)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return self.step[np.minimum((evidence / STEP).astype(int), BINS - 1)]


def rising(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Monotone probabilities of a histogram, by pooling neighbours that fall (a tenth of a row as prior)."""
    pools: list[list[float]] = []
    base = pos.sum() / max(n.sum(), 1)
    for p, t in zip(pos + 0.1 * base * (n > 0), n + 0.1 * (n > 0)):
        pools.append([p, t, 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            p2, t2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + t2, pools[-1][2] + w2]
    return np.concatenate([np.full(w, p / t if t else 0.0) for p, t, w in pools])


def labelled(docs: DataFrame, labels: DataFrame, most: int, key: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """Texts of at most ``most`` labelled rows with their label; no text is shuffled."""
    marks = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(toxic).alias("_y"))
    marks = marks.orderBy(F.xxhash64(key), key).limit(most)  # a proven bound, so the hint below is safe
    return docs.join(F.broadcast(marks), key)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """A model from the labelled rows of ``labels``; letters are counted over all of ``docs``."""
    bits = letter_model(docs, text)
    rows = labelled(docs.select(key, text), labels, max_labelled, key, toxic)
    size = rows.groupBy("_y").count().toPandas().set_index("_y")["count"].to_dict()
    p, n = float(size.get(1, 0)), float(size.get(0, 0))
    if not p:
        return Model(bits, np.zeros(0, np.uint64), np.zeros(0))
    a = 0.5
    weight = F.log((F.col("pos") + a) / (p + 2 * a)) - F.log((F.col("neg") + a) / (n + 2 * a))
    spread = F.sqrt(1 / (F.col("pos") + a) + 1 / (F.col("neg") + a))
    chosen = (
        feature_counts(rows, text, "_y", bits).where("pos >= 3").select("key", weight.alias("w"), (weight / spread).alias("z"))
        .where((F.col("w") >= HEAVY) & (F.col("z") >= 3)).orderBy(F.desc("z"), "key").limit(max_features).toArrow()
    )
    model = Model(bits, chosen["key"].to_numpy().view(np.uint64), chosen["w"].to_numpy())
    bins = (
        _evidence(rows, model, "_y", text).groupBy(F.least((F.col("evidence") / STEP).cast("int"), F.lit(BINS - 1)).alias("bin"))
        .agg(F.sum("_y").alias("pos"), F.count("*").alias("n")).toPandas()
    )
    pos, rows_in = np.zeros(BINS), np.zeros(BINS)
    pos[bins["bin"]], rows_in[bins["bin"]] = bins["pos"], bins["n"]
    model.step = rising(pos, rows_in)
    return model


def found(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    """``evidence, score`` of every text, an array for each array of texts."""
    decoder = Decoder(model.bits)
    for column in texts:
        buf, offs = blocks.flat(column)
        evidence = np.zeros(len(column))
        for a, b in blocks.slices(offs, TOGETHER):
            evidence[a:b] = model.evidence(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], decoder)
        yield pa.StructArray.from_arrays([pa.array(evidence), pa.array(model.score(evidence))], ["evidence", "score"])


def judge(spark: SparkSession, model: Model) -> Callable:
    """A function from a column of texts to ``struct<evidence, score>``: only texts go to Python, the rows stay where they are.

    Called non-deterministic so that a filter by its result does not have it worked out twice.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from found(texts, sent.value)
        blocks.release()

    return F.arrow_udf(run, "evidence double, score double").asNondeterministic()


def _evidence(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    judged = df.select(F.col(key), judge(df.sparkSession, model)(F.col(text)).alias("_found"))
    return judged.select(key, "_found.evidence", "_found.score")


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The key, ``score``, ``predicted`` (1 from the threshold on) and ``evidence`` of every row."""
    found = _evidence(df, model, key, text)
    return found.select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def restore(df: DataFrame, bits: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``words``: the text's words as meant, restored ones after the row's plain ones."""
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    @blocks.tidy
    def run(batches):
        decoder = Decoder(bits)
        for batch in batches:
            buf, offs = blocks.flat(batch.column(1))
            for a, b in blocks.slices(offs, TOGETHER):
                flat, s, e, row = words(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], decoder)
                at = blocks.per_row(row, b - a)
                found = [[flat[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(s[i:j], e[i:j])] for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.string()))], ["_key", "words"])

    return source.mapInArrow(run, blocks.shape(source, "_key", "words array<string>")).withColumnRenamed("_key", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "labels")
    held_out = blocks.remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": query}
ORACLES: dict[str, str] = {}
