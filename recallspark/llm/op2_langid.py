"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: how often every byte followed every context of up to
``order`` bytes. A byte seen in its longest context costs ``-log2(n / (T + D))`` bits
(``T`` sightings, ``D`` different bytes); an unseen one pays the escape,
``-log2(D / (T + D))``, and is priced in the next shorter context, in the end at 8 bits.
The statistics are frozen once counted, so a text's code length is a sum of looked-up
prices, and the language with the shortest code wins. No exclusions are applied.

Counting is a Spark aggregation over all training texts, and all nodes count. At most
``max_nodes`` of them are sent to the tasks as prices. Larger trees stay a written table:
only the prices of the most frequent longest contexts are sent, each taken from the full
counts; what else a text holds is summed from a join on the context and byte. The table is
priced in buckets of the two bytes before, where a context meets all its children and all
its shorter contexts but the last two, whose number is bounded by bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
everything if nothing could be learned; null ids count as remainder 0; equal code lengths
go to the first language by code point. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recallspark.llm import blocks

ORDER = 3
MAX_NODES = 1_000_000
#: Nodes that a bucket of a written table holds, about.
PER_BUCKET = 200_000
UNKNOWN = "und"


class Lookup:
    """Positions of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.zeros(1 << bits, np.uint64)
        self.slot_at = np.full(1 << bits, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._home(keys[todo]) + step) & self.mask
            free = self.slot_at[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.slot_at[taken], self.slot_key[taken] = put, keys[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            todo, step = todo[~placed[todo]], step + 1
        self.steps = step

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        at = self.slot_at[slot]
        hit = self.slot_key[slot] == keys
        out = np.where(hit, at, -1)
        rest = np.flatnonzero(~hit & (at >= 0))
        for step in range(1, self.steps):
            if not len(rest):
                break
            slot = (self._home(keys[rest]) + step) & self.mask
            at, hit = self.slot_at[slot], self.slot_key[slot] == keys[rest]
            out[rest[hit & (at >= 0)]] = at[hit & (at >= 0)]
            rest = rest[~hit & (at >= 0)]
        return out


def grams(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself and the ``order`` bytes before it; zeros stand before a text."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    place = np.arange(len(buf)) + (row + 1) * order
    padded = np.zeros(len(buf) + (len(offs) - 1) * order + 1, np.uint64)
    padded[place] = buf
    out = padded[place]
    for back in range(1, order + 1):
        out |= padded[place - back] << np.uint64(8 * back)
    return out


def counts(df: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """``lang, gram, n``: sightings of every longest context and byte, in all rows of ``df``."""

    def merged(held):
        out = {}
        for code, pairs in held.items():
            keys = np.concatenate([p[0] for p in pairs])
            unique, inverse = np.unique(keys, return_inverse=True)
            out[code] = [(unique, np.bincount(inverse, np.concatenate([p[1] for p in pairs])).astype(np.int64))]
        return out

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            codes = np.array(batch.column(1).to_pylist(), object)
            buf, offs = blocks.flat(batch.column(0))
            for a, b in blocks.slices(offs):
                here = grams(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], order)
                mine = np.repeat(np.unique(codes[a:b].astype(str), return_inverse=True)[1], np.diff(offs[a: b + 1]))
                for number, code in enumerate(np.unique(codes[a:b].astype(str))):
                    held.setdefault(str(code), []).append(np.unique(here[mine == number], return_counts=True))
                if sum(map(len, held.values())) > 64:
                    held = merged(held)
        for code, ((keys, n),) in merged(held).items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    learned = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    return learned.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Prices:
    """Code lengths of every known context and byte, per language."""

    def __init__(self, level: np.ndarray, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, langs: list[str] | None = None):
        self.langs = sorted(set(lang.tolist())) if langs is None else langs
        number = {x: i for i, x in enumerate(self.langs)}
        code = np.array([number[x] for x in lang], np.int64) if len(lang) else np.zeros(0, np.int64)
        self.order, self.tables = order, []
        for j in range(order + 1):
            here = level == j
            keys, at = np.unique(gram[here], return_inverse=True)
            seen = np.zeros((len(keys), len(self.langs)))
            np.add.at(seen, (at, code[here]), n[here])
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(context), len(self.langs)))
            kinds = total.copy()
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[of])
            shorter = self._price(j - 1, self._suffix(keys, j)) if len(keys) else own
            self.tables.append((Lookup(keys), np.where(seen > 0, own, escape[of] + shorter), Lookup(context), escape))

    @staticmethod
    def _suffix(keys, j):
        return keys & np.uint64((1 << (8 * j)) - 1)

    def _price(self, j: int, keys: np.ndarray) -> np.ndarray:
        if j < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        known, price, contexts, escape = self.tables[j]
        at = known.find(keys)
        if not len(price):
            return self._price(j - 1, self._suffix(keys, j))
        out = np.take(price, at, axis=0)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            context = contexts.find(keys[rest] >> np.uint64(8))
            paid = np.where((context >= 0)[:, None], escape[context], 0.0)
            out[rest] = paid + self._price(j - 1, self._suffix(keys[rest], j))
        return out

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of every row under every language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if not len(buf) or not self.langs:
            return out
        keys, row = grams(buf, offs, self.order), np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        step = max(1 << 16, (2 * blocks.SLICE) // len(self.langs))  # bounds the table of prices, also for one long text
        for at in range(0, len(keys), step):
            rows = row[at: at + step]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[first]] += np.add.reduceat(self._price(self.order, keys[at: at + step]), first, axis=0)
        return out


class Stored:
    """Prices of trees that are too large to send: all nodes as a table, the commonest prices at hand."""

    def __init__(self, nodes: DataFrame, size: int, order: int, max_nodes: int):
        self.nodes, self.order = nodes, order
        self.langs = sorted(r.lang for r in nodes.select("lang").distinct().collect())
        self.buckets = -(-size // PER_BUCKET)
        low = nodes.where(F.col("level") < min(2, order + 1)).toArrow()  # at most 65,536 + 256 a language
        self.low = nodes.sparkSession.sparkContext.broadcast(_columns(low))
        common = nodes.where(F.col("level") == order).groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram")
        got = self.priced(common.limit(max(1, max_nodes // len(self.langs))).select("gram")).toArrow()
        keys = got["gram"].to_numpy().astype(np.uint64)
        self.keys, self.price = keys, got["price"].combine_chunks().flatten().to_numpy().reshape(len(keys), len(self.langs))

    def _bucket(self, gram):
        return F.pmod(F.xxhash64(F.shiftright(gram, 8).bitwiseAND(0xFFFF)), F.lit(self.buckets)).cast("int").alias("bucket")

    def priced(self, asked: DataFrame) -> DataFrame:
        """``gram, price``: the price of different longest grams under every language."""
        langs, order, low = self.langs, self.order, self.low

        def run(nodes, grams):
            own = _columns(nodes)
            level, lang, gram, n = (np.concatenate(x) for x in zip(low.value, own))
            keys = grams["gram"].to_numpy().astype(np.uint64)
            price = Prices(level, lang, gram, n, order, langs)._price(order, keys)
            return pa.table({"gram": grams["gram"], "price": pa.array(list(price), pa.list_(pa.float64()))})

        deep = self.nodes.where("level >= 2").select(self._bucket(F.col("gram")), "lang", "level", "gram", "n")
        some = asked.select(self._bucket(F.col("gram")), "gram")
        return deep.groupBy("bucket").cogroup(some.groupBy("bucket")).applyInArrow(run, "gram bigint, price array<double>")


def _columns(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda name, kind: nodes[name].to_numpy().astype(kind)
    return column("level", np.int64), np.array(nodes["lang"].to_pylist(), object), column("gram", np.uint64), column("n", np.float64)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, max_nodes: int = MAX_NODES) -> Prices | Stored:
    """Context trees of all rows of ``df`` with a text and a language."""
    longest = counts(df, text, lang, order)
    level = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.col("gram").bitwiseAND(F.lit((1 << (8 * j + 8)) - 1)).alias("gram"))
                                for j in range(order + 1)]))
    nodes = blocks.settle(longest.select("lang", "n", level.alias("x")).groupBy("lang", "x.level", "x.gram").agg(F.sum("n").alias("n")))
    size = nodes.count()
    return Prices(*_columns(nodes.toArrow()), order) if size <= max_nodes else Stored(nodes, size, order, max_nodes)


def _judged(bits: np.ndarray, letter: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """Language, share of the likelihoods and code length of rows of code lengths."""
    known = letter & bool(langs)
    best = bits.argmin(axis=1) if langs else np.zeros(len(bits), int)
    least = bits.min(axis=1) if langs else np.zeros(len(bits))
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1) if langs else least
    return [pa.array([langs[i] if ok else UNKNOWN for i, ok in zip(best, known)], pa.string()),
            pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, least, 0.0))]


def predict(df: DataFrame, prices: Prices | Stored, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``lang_pred``, ``score`` (its share of the likelihoods) and ``bits`` of every row."""
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    shape = blocks.shape(source, "_key", "lang_pred string, score double, bits double")
    names = ["_key", "lang_pred", "score", "bits"]
    if isinstance(prices, Stored):
        langs, rows = prices.langs, _stored_bits(source, prices)

        def judge(batches):
            for batch in batches:
                if batch.num_rows:
                    bits = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(langs))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(bits, np.array(batch.column(1).to_pylist(), bool), langs)], names)

        return rows.mapInArrow(judge, shape).withColumnRenamed("_key", key)
    sent = df.sparkSession.sparkContext.broadcast(prices)

    def run(batches):
        model = sent.value
        for batch in batches:
            buf, offs = blocks.flat(batch.column(1))
            letter = np.array(batch.column(2).to_pylist(), bool)
            for a, b in blocks.slices(offs):
                bits = model.bits(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_judged(bits, letter[a:b], model.langs)], names)

    return source.mapInArrow(run, shape).withColumnRenamed("_key", key)


def _stored_bits(source: DataFrame, prices: Stored) -> DataFrame:
    """``_key, _letter, bits`` (an array) of every row: sent prices summed in the scan, the others by a join."""
    order, width = prices.order, len(prices.langs)
    sent = source.sparkSession.sparkContext.broadcast((Lookup(prices.keys), prices.price))

    def scan(batches):
        lookup, price = sent.value
        for batch in batches:
            buf, offs = blocks.flat(batch.column(1))
            for a, b in blocks.slices(offs):
                here = offs[a: b + 1] - offs[a]
                keys, row = grams(buf[offs[a]: offs[b]], here, order), np.repeat(np.arange(b - a), np.diff(here))
                at = lookup.find(keys)
                bits = np.zeros((b - a, width))
                for i in range(width):
                    bits[:, i] = np.bincount(row[at >= 0], price[at[at >= 0], i], b - a)
                rest = np.flatnonzero(at < 0)
                rest = rest[np.lexsort((keys[rest], row[rest]))]
                k, r = keys[rest], row[rest]
                new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
                times, cut = np.diff(np.append(new, len(k))), np.searchsorted(r[new], np.arange(b - a + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                                                  pa.array(list(bits), pa.list_(pa.float64())), lists(k[new]), lists(times)],
                                                 ["_key", "_letter", "_sent", "_grams", "_times"])

    found = source.mapInArrow(scan, blocks.shape(source, "_key", "_letter boolean, _sent array<double>, _grams array<bigint>, _times array<bigint>"))
    rows = blocks.settle(found.withColumn("_row", F.monotonically_increasing_id()))
    pairs = rows.select("_row", F.explode(F.arrays_zip("_grams", "_times")).alias("x")).select("_row", F.col("x._grams").alias("gram"), F.col("x._times").alias("times"))
    price = prices.priced(pairs.select("gram").distinct())
    parts = [F.sum(F.col("price")[i] * F.col("times")) for i in range(width)]
    rest = pairs.join(price, "gram").groupBy("_row").agg(F.array(*parts).alias("_rest"))
    both = F.when(F.col("_rest").isNull(), F.col("_sent")).otherwise(F.zip_with("_sent", "_rest", lambda x, y: x + y))
    return rows.join(rest, "_row", "left").select("_key", "_letter", both.alias("bits"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = blocks.read(spark, sf_dir, "documents")
    held_out = blocks.remainder(F.col("doc_id"), 3) == 1
    prices = fit(docs.where(~held_out))
    return predict(docs, prices).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_ppm_language": query}
ORACLES: dict[str, str] = {}
