"""Alignment of two tokenizers over the same bytes, by sparse token-byte matrices.

Each tokenizer's tokens over a text are the rows of a token-byte incidence matrix in CSR form
(row pointers, columns, values). Gustavson's row-wise product of one with the other's transpose
gives the overlap links: a pair of tokens and the number of bytes they share. Byte offsets
where tokens of both end cut the text into groups; the product of the token-group incidence
matrices links all tokens of one group.

Text is encoded with a space before it. Both tokenizers end a token before a single space that
a visible character follows, so texts are cut there, each different piece of a task is encoded
and multiplied once, and a text's tokens, links and groups are those of its pieces.

How many documents hold an id pair linked is counted over all of them. The most frequent pairs
(``HOT``, at most 1.5 MB) go with the tasks; texts meet the counts of all others in a join.

Defined results: a text that is null or empty, or whose tokens of either kind do not give back
its bytes, has no tokens: zeros, and an empty groups column. Repeated rows are documents of
their own and count each; null ids stay null. Only the named columns are read, so further
columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from recallspark.llm import blocks
from recallspark.llm.blocks import settle
from recallspark.llm.op9_bpe import byte_to_char, decode_flat, pieces, ragged

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs whose counts every task holds (12 bytes each); the rest is joined.
HOT = 1 << 17
#: Most pieces a task remembers between slices; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Bytes that are given to the tokenizers at once, about.
CHUNK = 1 << 14


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: ``ptr`` bounds each row's entries in ``col`` and ``val``."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.col, kind="stable")
        ptr = np.append(0, np.cumsum(np.bincount(self.col, minlength=self.width)))
        return Csr(ptr, self.rows()[order], self.val[order], len(self.ptr) - 1)


def incidence(place: np.ndarray, width: int, length: np.ndarray | None = None) -> Csr:
    """Rows that each hold a run of columns, from its first column and length (one if not given)."""
    length = np.ones(len(place), np.int64) if length is None else length
    col = ragged(place, length)
    return Csr(np.append(0, np.cumsum(length)), col, np.ones(len(col), np.int64), width)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Terms of each row of the product of ``a`` and ``b`` before equal columns are merged."""
    terms = np.append(0, np.cumsum(np.diff(b.ptr)[a.col]))
    return terms[a.ptr[1:]] - terms[a.ptr[:-1]]


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson: row i of the result sums the rows of ``b`` that the entries of row i of ``a`` name."""
    length = np.diff(b.ptr)[a.col]
    at = ragged(b.ptr[:-1][a.col], length)
    key = np.repeat(a.rows(), length) * b.width + b.col[at]
    val = np.repeat(a.val, length) * b.val[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, val = key[order], val[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    val = np.add.reduceat(val, first) if len(first) else val
    row, col = np.divmod(key[first], max(b.width, 1))
    return Csr(np.searchsorted(row, np.arange(len(a.ptr))), col, val, b.width)


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings])).astype(np.int64)


@functools.lru_cache(2)
def first_tokenizer(file: bytes):
    """The byte-level tokenizer, and each id's bytes as flat array and offsets."""
    made = Tokenizer.from_buffer(file)
    made.encode_special_tokens = True
    vocabulary = made.get_vocab()
    back = {c: b for b, c in enumerate(byte_to_char())}
    strings = [b""] * (max(vocabulary.values()) + 1)
    for string, i in vocabulary.items():
        strings[i] = bytes(back[c] for c in string)
    return made, *_table(strings)


@functools.lru_cache(2)
def second_tokenizer(file: bytes):
    """The sentence-piece tokenizer, and each id's bytes as flat array and offsets."""
    made = sentencepiece.SentencePieceProcessor(model_proto=file)
    strings = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        strings.append(bytes([int(piece[1:-1], 16)]) if made.is_byte(i) else piece.replace("▁", " ").encode())
    return made, *_table(strings)


def files() -> tuple[bytes, bytes]:
    """Both vocabularies as bytes, read by the driver once (two megabytes) and sent along with the tasks."""
    found = []
    for name in (FIRST, SECOND):
        with open(public_tokenizers.path(name), "rb") as file:
            found.append(file.read())
    return tuple(found)


@dataclass
class Aligned:
    """Tokens, links and groups of a list of strings laid end to end; ``*_at`` bounds each string's share."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    links: Csr
    group_a: np.ndarray
    group_b: np.ndarray
    good: np.ndarray

    def group_matrices(self) -> tuple[Csr, Csr]:
        """Token-group incidence of the first, and group-token incidence of the second kind."""
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        return incidence(self.group_a, groups), incidence(self.group_b, groups).transposed()


def visible(byte: np.ndarray) -> np.ndarray:
    """Bytes that begin a visible character: ASCII, or a lead byte that no white space begins with."""
    return ((byte > 0x20) & (byte < 0x7F)) | (byte >= 0xC3) & ~np.isin(byte, (0xE1, 0xE2, 0xE3))


class Aligner:
    def __init__(self, first: bytes, second: bytes):
        self.one, self.table_a, self.offs_a = first_tokenizer(first)
        self.two, self.table_b, self.offs_b = second_tokenizer(second)
        self.width = len(self.offs_b) - 1
        self.digits, self.digits_at = _table([str(i).encode() for i in range(max(len(self.offs_a), len(self.offs_b)))])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)
        self.codes, self.code_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.spellings: list[bytes] = []

    def _ids(self, raw: list[bytes]) -> tuple[list, list]:
        """Ids of strings that begin with a space, which the second tokenizer adds by itself."""
        texts = [s.decode("utf-8", "replace") for s in raw]
        first = self.one.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in first], [np.array(x, np.int64) for x in self.two.encode([t[1:] for t in texts], num_threads=1)]

    def _fits(self, a: np.ndarray, b: np.ndarray, raw: bytes, ends: np.ndarray) -> bool:
        """Whether both kinds of tokens give ``raw`` back and end at all of ``ends``."""
        for ids, table, offs in ((a, self.table_a, self.offs_a), (b, self.table_b, self.offs_b)):
            flat, length = decode_flat(ids, table, offs)
            if flat.tobytes() != raw or not np.isin(ends, np.cumsum(length)).all():
                return False
        return True

    def _chunks(self, strings: list[bytes]) -> tuple[bytes, np.ndarray, list[int]]:
        """All strings end to end, their bounds, and where to cut for encoding several at once.

        A string that is a space and a visible character at its start can follow any other: a token
        of either kind begins there anyway.
        """
        raw = b"".join(strings)
        at = np.append(0, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings))))
        second = np.frombuffer(raw, np.uint8)[np.minimum(at[:-1] + 1, max(len(raw) - 1, 0))] if raw else np.zeros(len(strings), np.uint8)
        alone = ~visible(second)
        cut = [0]
        for x, y in blocks.slices(at, CHUNK):
            cut += [*(np.flatnonzero(alone[x:y]) + x).tolist(), y]
        return raw, at, sorted({*cut, len(strings)})

    def align(self, strings: list[bytes]) -> Aligned:
        """Strings whose tokens do not give them back are not ``good`` and have none."""
        raw, at, cut = self._chunks(strings)
        parts = [raw[at[x]: at[y]] for x, y in zip(cut[:-1], cut[1:])]
        good = np.ones(len(strings), bool)
        found_a, found_b = [], []
        for x, y, part, a, b in zip(cut[:-1], cut[1:], parts, *self._ids(parts)):
            if self._fits(a, b, part, at[x + 1: y + 1] - at[x]):
                found_a.append(a)
                found_b.append(b)
                continue
            for i, a, b in zip(range(x, y), *self._ids(strings[x:y])):
                good[i] = self._fits(a, b, strings[i], np.array([len(strings[i])]))
                if good[i]:
                    found_a.append(a)
                    found_b.append(b)
        flat_a, flat_b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        length_a, length_b = self.offs_a[flat_a + 1] - self.offs_a[flat_a], self.offs_b[flat_b + 1] - self.offs_b[flat_b]
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
        bounds = np.append(0, np.cumsum(np.diff(at) * good))
        total = int(bounds[-1])
        rows_a, rows_b = incidence(ends_a - length_a, total, length_a), incidence(ends_b - length_b, total, length_b)
        both, other = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        both[ends_a] = True
        other[ends_b] = True
        group = np.append(0, np.cumsum(both & other))  # groups that end at or before an offset
        return Aligned(flat_a, flat_b, np.searchsorted(ends_a, bounds, "right"), np.searchsorted(ends_b, bounds, "right"),
                       product(rows_a, rows_b.transposed()), group[ends_a], group[ends_b], good)

    def spelled(self, found: Aligned) -> tuple[bytes, np.ndarray]:
        """``a,a|b;a|b,b;`` of everything, and where each string's share begins."""
        key = np.concatenate([found.group_a * 2, found.group_b * 2 + 1])
        order = np.argsort(key, kind="stable")
        ids, key = np.concatenate([found.a, found.b])[order], key[order]
        length = self.digits_at[ids + 1] - self.digits_at[ids]
        ends = np.cumsum(length + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ragged(ends - length - 1, length)] = self.digits[ragged(self.digits_at[ids], length)]
        after = np.append(key[1:], -1)
        out[ends - 1] = np.where(after == key, ord(","), np.where(key % 2 == 0, ord("|"), ord(";")))
        return out.tobytes(), np.append(0, ends)[found.a_at + found.b_at]

    def learn(self, strings: list[bytes]) -> None:
        """Remember counts, linked id pairs and spelled groups of each string."""
        found = self.align(strings)
        spelled, at = self.spelled(found)
        codes = (found.a[found.links.rows()] * self.width + found.b[found.links.col]).astype(np.int32)
        link_at = found.links.ptr[found.a_at]
        shared = np.append(0, np.cumsum(row_sizes(*found.group_matrices())))[found.a_at]
        last = np.append(-1, found.group_a)[found.a_at]
        self.known.update(zip(strings, range(len(self.good), len(self.good) + len(strings))))
        self.good = np.append(self.good, found.good)
        self.counts = np.concatenate([self.counts, np.stack([np.diff(x) for x in (found.a_at, found.b_at, last, shared)], 1)])
        self.code_at = np.append(self.code_at, self.code_at[-1] + link_at[1:])
        self.codes = np.append(self.codes, codes)
        cuts = at.tolist()
        self.spellings += [spelled[x: y - 1] if y > x else b"" for x, y in zip(cuts[:-1], cuts[1:])]

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: counts and digest; then row, code and times of each id pair it holds linked."""
        n = len(offs) - 1
        place = np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offs))
        spaced = np.full(len(buf) + n, 0x20, np.uint8)
        spaced[place] = buf
        at = offs + np.arange(n + 1)
        start = pieces(spaced, at)
        # Not after another space: there one tokenizer may go on.
        start = start[(spaced[start - 1] != 0x20) | np.isin(start, at)]
        bounds = np.append(start, len(spaced)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(spaced)]).dictionary_encode()
        names, piece = array.dictionary.to_pylist(), array.indices.to_numpy().astype(np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        if b" " not in self.known:
            self._remember_nothing()
        new = [s for s in names if s not in self.known]
        for x, y in blocks.slices(np.append(0, np.cumsum([len(s) for s in new]))) if new else ():
            self.learn(new[x:y])
        each = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        row = np.searchsorted(at, start, "right") - 1
        good = np.ones(n, bool)
        good[row[~self.good[each[piece]]]] = False
        counts = [np.bincount(row, weights=self.counts[each[piece], k], minlength=n).astype(np.int64) for k in range(4)]
        ids, bound = each[piece].tolist(), np.searchsorted(row, np.arange(n + 1)).tolist()
        spelled = self.spellings
        digests = [hashlib.sha256(b";".join([spelled[i] for i in ids[x:y]])).hexdigest() if c else "" for x, y, c in zip(bound[:-1], bound[1:], counts[0].tolist())]
        held, times = np.unique(row * len(names) + piece, return_counts=True)
        holder, piece = np.divmod(held, max(len(names), 1))
        size = np.diff(self.code_at)[each[piece]]
        codes = self.codes[ragged(self.code_at[each[piece]], size)].astype(np.int64)
        key, times = np.repeat(holder, size) << 32 | codes, np.repeat(times, size)
        out = [*counts, digests]
        if not good.all():
            key, times = self._whole(spaced, at, good, out, key, times)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        return out, key[first] >> 32, key[first] & 0xFFFFFFFF, times

    def _remember_nothing(self) -> None:
        """A lone space is an empty text: good, and without tokens."""
        self.known[b" "] = len(self.good)
        self.good = np.append(self.good, True)
        self.counts = np.concatenate([self.counts, np.zeros((1, 4), np.int64)])
        self.code_at = np.append(self.code_at, self.code_at[-1])
        self.spellings.append(b"")

    def _whole(self, spaced, at, good, out, key, times):
        """Texts with a piece that its tokens do not give back, encoded as wholes: only these decide."""
        keep = good[key >> 32]
        keys, many = [key[keep]], [times[keep]]
        for r in np.flatnonzero(~good).tolist():
            found = self.align([spaced[at[r]: at[r + 1]].tobytes()])
            spelled = self.spelled(found)[0][:-1]
            figures = (len(found.a), len(found.b), int(found.group_a[-1]) + 1 if len(found.a) else 0, int(row_sizes(*found.group_matrices()).sum()))
            for column, value in zip(out, figures):
                column[r] = value
            out[4][r] = hashlib.sha256(spelled).hexdigest() if spelled else ""
            code = found.a[found.links.rows()] * self.width + found.b[found.links.col]
            keys.append(np.int64(r) << 32 | code)
            many.append(np.ones(len(code), np.int64))
        return np.concatenate(keys), np.concatenate(many)


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def tokens_and_links(df: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[bytes, bytes] | None = None) -> DataFrame:
    """Real outputs of every text: ids of both kinds, ``links`` of token positions with the bytes
    they share, and the ``groups`` as lists of ids of both kinds."""
    first, second = vocabularies or files()
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    pair = "array<struct<a:int,b:int,bytes:int>>"
    made = blocks.shape(source, "_key", f"a_ids array<int>, b_ids array<int>, links {pair}, groups array<struct<a:array<int>,b:array<int>>>")

    def one(aligner: Aligner, string: bytes) -> tuple:
        found = aligner.align([string]) if len(string) > 1 else None
        if found is None or not len(found.a):
            return [], [], [], []
        links = zip(found.links.rows().tolist(), found.links.col.tolist(), found.links.val.tolist())
        cut_a, cut_b = (blocks.per_row(g, int(found.group_a[-1]) + 1) for g in (found.group_a, found.group_b))
        groups = [{"a": found.a[w:x].tolist(), "b": found.b[y:z].tolist()} for w, x, y, z in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:])]
        return found.a.tolist(), found.b.tolist(), [{"a": a, "b": b, "bytes": n} for a, b, n in links], groups

    def run(batches: Iterator[pa.RecordBatch]):
        aligner = Aligner(first, second)
        types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32(), "bytes": pa.int32()})),
                 pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())}))]
        for batch in batches:
            buf, offs = blocks.flat(batch.column(1))
            for x, y in blocks.slices(offs):
                raw = buf[offs[x]: offs[y]].tobytes()
                found = [one(aligner, b" " + raw[p - offs[x]: q - offs[x]]) for p, q in zip(offs[x:y], offs[x + 1: y + 1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), *(pa.array(list(c), t) for c, t in zip(zip(*found), types))],
                    ["_key", "a_ids", "b_ids", "links", "groups"])

    return source.mapInArrow(run, made).withColumnRenamed("_key", key)


def shared_groups(aligned: Aligned) -> Csr:
    """All pairs of tokens that lie in one group."""
    return product(*aligned.group_matrices())


def encoded(df: DataFrame, key: str, text: str, first: bytes, second: bytes) -> DataFrame:
    """One row per text: ``id``, counts, digest, and the id pairs it holds linked with their times."""
    source = df.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    counts = ["n_a", "n_b", "n_groups", "n_shared"]
    made = blocks.shape(source, "id", ", ".join(f"{c} bigint" for c in counts) + ", groups_sha256 string, codes array<int>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]):
        aligner = Aligner(first, second)
        for batch in batches:
            buf, offs = blocks.flat(batch.column(1))
            for x, y in blocks.slices(offs):
                out, row, codes, times = aligner.rows(buf[offs[x]: offs[y]], offs[x: y + 1] - offs[x])
                columns = [batch.column(0).slice(x, y - x), *(pa.array(c) for c in out[:4]), pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _lists(row, codes, y - x), _lists(row, times, y - x)], ["id", *counts, "groups_sha256", "codes", "times"])

    return source.mapInArrow(run, made)


def counted(rows: DataFrame, pairs: DataFrame, hot: int) -> DataFrame:
    """``n_links, n_best, count_sum`` of every row (by ``row_id``), from pairs ``code, n, best``.

    The ``hot`` most frequent pairs are looked up where the rows are read; the others are joined.
    """
    table = pairs.orderBy(F.desc("n"), "code").limit(hot).toArrow()
    order = np.argsort(table["code"].to_numpy())
    code, n, best = (table[c].to_numpy()[order] for c in ("code", "n", "best"))
    keep = [c for c in rows.columns if c not in ("codes", "times")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column("codes")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            mine, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(code, mine), max(len(code) - 1, 0))
            hit = code[at] == mine if len(code) else np.zeros(len(mine), bool)
            sums = [np.zeros(len(lists), np.int64) for _ in range(3)]
            np.add.at(sums[0], row, times)
            np.add.at(sums[1], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[2], row[hit], times[hit] * n[at[hit]])
            rest = ~hit
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *map(pa.array, sums), _lists(row[rest], mine[rest], len(lists)), _lists(row[rest], times[rest], len(lists))],
                [*keep, "n_links", "n_best", "count_sum", "codes", "times"])

    fields = [rows.schema[c] for c in keep]
    made = blocks.T.StructType(fields + blocks.T.StructType.fromDDL(
        "n_links bigint, n_best bigint, count_sum bigint, codes array<int>, times array<int>").fields)
    near = settle(rows.mapInArrow(run, made))
    rest = near.select("row_id", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("times").alias("many"))))
    met = rest.join(pairs, "code").groupBy("row_id").agg(
        F.sum(F.col("many") * F.col("best")).alias("more_best"), F.sum(F.col("many") * F.col("n")).alias("more_sum"))
    return near.drop("codes", "times").join(met, "row_id", "left").withColumn(
        "n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))


def alignment(df: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[bytes, bytes] | None = None, hot: int = HOT) -> DataFrame:
    """Per text: the key, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and
    ``n_shared``, the number of token pairs that lie in one group."""
    first, second = vocabularies or files()
    width = len(second_tokenizer(second)[2]) - 1
    rows = settle(encoded(df, key, text, first, second).withColumn("row_id", F.monotonically_increasing_id()))
    pairs = settle(rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")))
    kind = (F.col("code") / width).cast("int")
    most = pairs.groupBy(kind.alias("kind")).agg(F.max("n").alias("most"))  # one row per id of the first vocabulary at most
    pairs = settle(pairs.withColumn("kind", kind).join(most, "kind").select("code", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best")))
    return counted(rows, pairs, hot).select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def query(spark, sf_dir: str) -> DataFrame:
    return alignment(blocks.read(spark, sf_dir, "documents"))


QUERIES = {"op13_alignment": query}
ORACLES: dict[str, str] = {}
