"""Byte-level BPE with the tokenizers library: encode whole texts, and decode ids.

Texts are cut before every space that a visible character follows. The pattern always
starts a new match there, so pieces can be encoded on their own; each different piece
of a slice is encoded once, by the library, and its ids are laid out wherever it stands.
Every text is decoded again in the same pass; one that does not come back byte for byte
(two pieces under one 64-bit key) is encoded whole.

Defined results: a null text counts as empty; an empty text has no ids. Repeated rows
give repeated results. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from recallspark.llm import blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most pieces a task remembers between slices; beyond it the memory starts afresh.
REMEMBERED = 300_000


def byte_to_char() -> list[str]:
    """Printable stand-in of each byte: itself where visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(visible))
    shifted = {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [shifted.get(b, chr(b)) for b in range(256)]


@functools.lru_cache(2)
def tokenizer(ranks: bytes) -> tuple[Tokenizer, np.ndarray, np.ndarray]:
    """The library's tokenizer for a rank file, and each id's bytes as flat array and offsets."""
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    chars = byte_to_char()
    shown = {token: "".join(chars[b] for b in token) for token in rank}
    halves = sorted(
        (r, rank[token[:i]], rank[token[i:]], token[:i], token[i:])
        for token, r in rank.items() for i in range(1, len(token)) if token[:i] in rank and token[i:] in rank)
    made = Tokenizer(models.BPE({shown[t]: r for t, r in rank.items()},
                                [(shown[a], shown[b]) for *_, a, b in halves], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.decoder = decoders.ByteLevel()
    size = max(rank.values()) + 1
    back = {c: b for b, c in enumerate(chars)}
    strings = [b""] * size
    for string, r in made.get_vocab().items():
        strings[r] = bytes(back[c] for c in string)
    offs = np.zeros(size + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=offs[1:])
    return made, np.frombuffer(b"".join(strings), np.uint8), offs


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of every span laid end to end."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of independently encodable pieces, every row's start included."""
    cut = np.zeros(len(buf) + 1, bool)
    after = np.append(buf[1:], np.uint8(0))
    # The next character is visible: ASCII, or led by a byte that no white space starts with.
    seen = ((after > 0x20) & (after < 0x7F)) | (after >= 0xC3) & ~np.isin(after, (0xE1, 0xE2, 0xE3))
    cut[:-1] = (buf == 0x20) & seen
    cut[offs[1:-1] - 1] = False  # a row's last byte: what follows belongs to the next row
    if len(buf):
        cut[len(buf) - 1] = False
    cut[offs] = True
    return np.flatnonzero(cut[:-1])


def decode_flat(ids: np.ndarray, table: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids laid end to end, and each id's length in bytes."""
    length = offs[ids + 1] - offs[ids]
    return table[ragged(offs[ids], length)], length


class Encoder:
    def __init__(self, ranks: bytes):
        self.library, self.table, self.offs = tokenizer(ranks)
        self.known: dict[int, bytes] = {}

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded bytes of every row."""
        start = pieces(buf, offs)
        end = np.append(start[1:], len(buf))
        keys, first, inverse = np.unique(blocks.span_hash(buf, start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        names = keys.tolist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [i for i, key in enumerate(names) if key not in self.known]
        found = self._encode([raw[start[i]: end[i]].decode("utf-8", "replace") for i in first[new]])
        self.known.update(zip((names[i] for i in new), found))
        each = [self.known[key] for key in names]
        width = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        begin = np.cumsum(width) - width
        ids = flat[ragged(begin[inverse], width[inverse])]
        back, length = decode_flat(ids.astype(np.int64), self.table, self.offs)
        rows = np.searchsorted(offs, start, "right") - 1
        counts = np.bincount(rows, weights=width[inverse], minlength=len(offs) - 1).astype(np.int64)
        id_at = np.concatenate([[0], np.cumsum(counts)])
        byte_at = np.concatenate([[0], np.cumsum(length)])[id_at]
        ids_raw, back_raw = ids.astype("<u4").tobytes(), back.tobytes()
        out = []
        for r in range(len(offs) - 1):
            mine, text = ids_raw[4 * id_at[r]: 4 * id_at[r + 1]], raw[offs[r]: offs[r + 1]]
            decoded = back_raw[byte_at[r]: byte_at[r + 1]]
            if decoded != text:
                mine = self._encode([text.decode("utf-8", "replace")])[0]
                decoded = decode_flat(np.frombuffer(mine, "<u4").astype(np.int64), self.table, self.offs)[0].tobytes()
            out.append((mine, decoded))
        return out


def rank_file(path: str | None = None) -> bytes:
    """The vocabulary as bytes, read by the driver once (under a megabyte) and sent along with the tasks."""
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        return file.read()


def _numbers(lists: list[bytes]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(lists), "<u4").astype(np.int32)))


def _char_offsets(ids: bytes, decoded: bytes, encoder: Encoder) -> tuple[bytes, bytes]:
    """First and past-the-last character that each id's bytes touch."""
    at = np.frombuffer(ids, "<u4").astype(np.int64)
    ends = np.cumsum(encoder.offs[at + 1] - encoder.offs[at])
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    lead = np.cumsum((np.frombuffer(decoded, np.uint8) & 0xC0) != 0x80)
    if not len(at):
        return b"", b""
    return (lead[starts] - 1).astype("<u4").tobytes(), lead[ends - 1].astype("<u4").tobytes()


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: bytes | None = None,
           offsets: bool = False, digests: bool = False, check: bool = False) -> DataFrame:
    """One row per text: the key, ``n_tokens``, and ``ids``.

    ``offsets`` adds ``starts`` and ``ends``, the characters each id touches; ``digests``
    gives SHA-256 of ids and of the decoded bytes in place of the ids themselves. ``check``
    adds ``round_trip``: whether the ids, decoded in the same pass, gave the text back.
    """
    ranks = ranks or rank_file()
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    extra = ("ids_sha256 string, decoded_sha256 string" if digests
             else "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")) + (", round_trip boolean" if check else "")

    @blocks.tidy
    def run(batches):
        encoder = Encoder(ranks)
        for batch in batches:
            keys, (buf, offs) = batch.column(0), blocks.flat(batch.column(1))
            for a, b in blocks.slices(offs):
                got = encoder.rows(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                ids = [g[0] for g in got]
                columns = [keys.slice(a, b - a), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                                pa.array([hashlib.sha256(g[1]).hexdigest() for g in got])]
                else:
                    columns.append(_numbers(ids))
                    if offsets:
                        both = [_char_offsets(*g, encoder) for g in got]
                        columns += [_numbers([x[0] for x in both]), _numbers([x[1] for x in both])]
                if check:
                    raw = buf[offs[a]: offs[b]].tobytes()
                    at = (offs[a: b + 1] - offs[a]).tolist()
                    columns.append(pa.array([g[1] == raw[x:y] for g, x, y in zip(got, at[:-1], at[1:])], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["_key", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", *(["starts", "ends"] if offsets else [])]), *(["round_trip"] if check else [])]
    return source.mapInArrow(run, blocks.shape(source, "_key", f"n_tokens bigint, {extra}")).withColumnRenamed("_key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """The key, ``bytes`` and ``text`` of every list of ids.

    Bytes are exact. In ``text`` a character that the list begins or ends inside of
    becomes U+FFFD. Null lists and ids outside the vocabulary (or null) give no bytes.
    """
    ranks = ranks or rank_file()
    source = df.select(F.col(key).alias("_key"), F.col(ids).cast("array<bigint>").alias("_ids"))

    @blocks.tidy
    def run(batches):
        _, table, offs = tokenizer(ranks)
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy()
            known = (flat >= 0) & (flat < len(offs) - 1)
            back, length = decode_flat(flat[known], table, offs)
            each = np.zeros(len(flat), np.int64)
            each[known] = length
            at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(size)])].tolist()
            joined = back.tobytes()
            raw = [joined[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])],
                ["_key", "bytes", "text"])

    return source.mapInArrow(run, blocks.shape(source, "_key", "bytes binary, text string")).withColumnRenamed("_key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(blocks.read(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op9_bpe": query}
ORACLES: dict[str, str] = {}
