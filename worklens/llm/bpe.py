"""Byte-level BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A text is cut at the special strings (where asked), then by the pattern of the vocabulary; each
stretch is a row of bytes, one symbol a byte. The leaves of a segment tree hold the ranks of the
adjacent pairs, each joined with its place, so that the root is the leftmost pair of the lowest
rank. That pair is merged, its leaf and those of its two neighbours are set anew, and the paths
above them recomputed, until the root says that no pair can be merged.

Trees of equal size stand in one array and are merged in step, one pair of each tree a round;
a stretch over IN_STEP bytes has a tree of its own. Both give the same ids. Ids of stretches met
before are remembered by the worker process, a bounded number of them.

Decoding joins the bytes of the ids; what is no UTF-8 reads as U+FFFD.

Defined results: a null or empty text has no ids and decodes to empty text; texts of any length
are read whole; repeated rows, null ids and empty tables need no case; ``with_ids`` keeps further
columns under their own names, and replaces one named as its output. An id out of the vocabulary
is refused.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import CHUNK_BYTES, bounded, chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: where a text is cut before any merge.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Longest stretch, in bytes, whose tree stands among others.
IN_STEP = 64
#: Stretches that a worker remembers, and the longest of them in code points.
REMEMBERED, LONGEST = 500_000, 64
NONE = 1 << 24


@dataclass
class Vocabulary:
    byte: np.ndarray              # id of each byte
    pairs: np.ndarray             # sorted: left id * size + right id
    rank: np.ndarray              # of each pair
    merged: np.ndarray            # by rank: the id that the pair becomes
    raw: pa.Array                 # bytes of each id
    special: dict[str, int]
    known: dict[str, bytes] = field(default_factory=dict)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the vocabulary doesn't merge it."""
        key = left.astype(np.int64) * len(self.raw) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], NONE)

    @property
    def table(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.pairs.tolist(), self.rank.tolist()))
        return self._table


def _letters() -> dict[str, int]:
    """The byte that each letter of a written piece stands for: printable Latin-1 for itself,
    the other bytes for the letters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Vocabulary:
    """Read once by each worker process."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cut = told["model"], told["pre_tokenizer"]
    if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"]:
        raise ValueError(f"{path} is no byte-level BPE vocabulary without a leading space")
    ids, letter = model["vocab"], _letters()
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    raw: list[bytes | None] = [None] * (max([*ids.values(), *special.values()]) + 1)
    for piece, i in ids.items():
        raw[i] = bytes(letter[c] for c in piece)
    for piece, i in special.items():
        raw[i] = piece.encode()
    byte = np.full(256, -1, np.int64)
    for c, b in letter.items():
        byte[b] = ids[c]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([ids[a] * len(raw) + ids[b] for a, b in merges], np.int64)
    order = np.argsort(pairs)
    return Vocabulary(byte, pairs[order], order.astype(np.int64),
                      np.array([ids[a + b] for a, b in merges], np.int64),
                      pa.array(raw, pa.large_binary()), special)


def _climb(tree: np.ndarray, row: np.ndarray, at: np.ndarray) -> None:
    """Recomputes the nodes above the given leaves, one level after the other."""
    at = at >> 1
    while at[0]:
        tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
        at = at >> 1


def _in_step(symbols: np.ndarray, many: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows of ``symbols`` (the first ``many`` of each count), one after another, and
    how many of each row."""
    n, width = symbols.shape
    size = 1 << max(1, (width - 1).bit_length())
    column = np.arange(width)
    alive = column < many[:, None]
    after = np.where(column + 1 < many[:, None], column + 1, -1)
    before = np.broadcast_to(column - 1, symbols.shape).copy()
    tree = np.full((n, 2 * size), NONE * size, np.int64)
    pair = alive[:, 1:]
    row, at = np.nonzero(pair)
    tree[row, size + at] = v.ranks(symbols[row, at], symbols[row, at + 1]) * size + at
    for level in range(size.bit_length() - 2, -1, -1):
        k = np.arange(1 << level, 2 << level)
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    row = np.arange(n)
    while True:
        root = tree[row, 1]
        row, root = row[root < NONE * size], root[root < NONE * size]
        if not len(row):
            break
        at = root % size
        gone = after[row, at]
        symbols[row, at] = v.merged[root // size]
        alive[row, gone] = False
        tree[row, size + gone] = NONE * size
        then = after[row, gone]
        after[row, at] = then
        some = np.flatnonzero(then >= 0)
        before[row[some], then[some]] = at[some]
        tree[row, size + at] = NONE * size
        tree[row[some], size + at[some]] = v.ranks(
            symbols[row[some], at[some]], symbols[row[some], then[some]]) * size + at[some]
        prior = before[row, at]
        front = np.flatnonzero(prior >= 0)
        tree[row[front], size + prior[front]] = v.ranks(
            symbols[row[front], prior[front]], symbols[row[front], at[front]]) * size + prior[front]
        _climb(tree, row, size + gone)
        _climb(tree, row, size + at)
        if len(front):
            _climb(tree, row[front], size + prior[front])
    return symbols[alive], alive.sum(axis=1)


def _alone(symbols: list[int], v: Vocabulary) -> list[int]:
    """Ids of one row of symbols of any length."""
    n, table, most = len(symbols), v.table, len(v.raw)
    size = 1 << max(1, (n - 1).bit_length())
    none = NONE * size
    tree = array("q", [none]) * (2 * size)

    def key(i: int, j: int) -> int:
        rank = table.get(symbols[i] * most + symbols[j])
        return none if rank is None else rank * size + i
    for i in range(n - 1):
        tree[size + i] = key(i, i + 1)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = array("q", [*range(1, n), -1]), array("q", range(-1, n - 1))

    def put(leaf: int, to: int) -> None:
        k = size + leaf
        tree[k] = to
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1
    while tree[1] < none:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        then = after[gone]
        symbols[at] = int(v.merged[rank])
        after[at] = then
        put(gone, none)
        if then >= 0:
            before[then] = at
        put(at, key(at, then) if then >= 0 else none)
        if before[at] >= 0:
            put(before[at], key(before[at], at))
    ids, at = [], 0
    while at >= 0:
        ids.append(symbols[at])
        at = after[at]
    return ids


def merge(stretches: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of each non-empty stretch, as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(stretches)
    coded = [s.encode() for s in stretches]
    length = np.array([len(c) for c in coded], np.int64)
    for low, high in [(0, 4), (4, 8), (8, 16), (16, 32), (32, IN_STEP)]:
        here = np.flatnonzero((length > low) & (length <= high))
        for part in np.array_split(here, 1 + len(here) * high // 2_000_000):
            if not len(part):
                continue
            data = np.frombuffer(b"".join(coded[k].ljust(high, b"\0") for k in part), np.uint8)
            ids, many = _in_step(v.byte[data].reshape(-1, high), length[part], v)
            packed, at = ids.astype("<u4").tobytes(), 0
            for k, m in zip(part.tolist(), (4 * many).tolist()):
                out[k] = packed[at:at + m]
                at += m
    for k in np.flatnonzero(length > IN_STEP).tolist():
        out[k] = np.array(_alone([int(i) for i in v.byte[np.frombuffer(coded[k], np.uint8)]], v),
                          "<u4").tobytes()
    return out


_CUT = regex.compile(PATTERN)
#: The same for texts of ASCII alone, where the classes are short.
_CUT_ASCII = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
                        .replace(" ?A-Za-z+| ?0-9+", " ?[A-Za-z]+| ?[0-9]+"), re.ASCII)


def _stretches(text: str) -> list[str]:
    return (_CUT_ASCII if text.isascii() else _CUT).findall(text)


def encode(texts: list[str], v: Vocabulary, special: bool = True) -> list[bytes]:
    """Ids of each text, packed as by ``merge``; ``special`` says whether special strings
    within a text are ids of their own or plain text."""
    marks = regex.compile("(" + "|".join(
        regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") \
        if special and v.special else None
    parted = []
    for text in texts:
        if marks is not None and marks.search(text):
            parts = [[p] if p in v.special else _stretches(p) for p in marks.split(text) if p]
            parted.append([s for p in parts for s in p])
        else:
            parted.append(_stretches(text))
    if len(v.known) > REMEMBERED:
        v.known.clear()
    wanted = set().union(*parted).difference(v.known)
    fresh = {s: np.array([v.special[s]], "<u4").tobytes() for s in wanted
             if marks is not None and s in v.special}
    plain = [s for s in wanted if s not in fresh]
    found = dict(zip(plain, merge(plain, v))) | fresh
    v.known.update(found)
    out = [b"".join(map(v.known.__getitem__, parts)) for parts in parted]
    for s in found:
        # A special string that is plain text here, or the other way round, is not remembered.
        if len(s) > LONGEST or s in v.special:
            del v.known[s]
    return out


def decode(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of rows of ids, where row k is ``ids[at[k]:at[k + 1]]``."""
    if len(ids) and int(ids.max()) >= len(v.raw):
        raise ValueError(f"the vocabulary has no id {int(ids.max())}")
    taken = v.raw.take(pa.array(ids.astype(np.int64)))
    if taken.null_count:
        raise ValueError("the vocabulary leaves out an id that is to be decoded")
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[:len(ids) + 1][at]
    whole = memoryview(data if data is not None else b"")
    return [str(whole[a:b], "utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _bounds(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)])
    return np.frombuffer(b"".join(packed), "<u4"), at


def _listed(packed: list[bytes]) -> pa.ListArray:
    ids, at = _bounds(packed)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts, null as empty, a bounded number of bytes at a time."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part, _, _ in chunks([batch], "text", CHUNK_BYTES):
        yield [t or "" for t in part.column(0).to_pylist()]


def with_ids(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", ids_col: str = "ids",
             special: bool = True) -> DataFrame:
    """``docs`` and the ids of each text, array<int>."""
    def run(column: pa.Array) -> pa.Array:
        v = load(path)
        lists = [_listed(encode(texts, v, special)) for texts in _slices(column)]
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
    return bounded(docs).withColumn(ids_col, F.arrow_udf(run, "array<int>")(F.col(text_col)))


def decoded(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of a column of ids; null is empty."""
    def run(column: pa.Array) -> pa.Array:
        many = np.array(column.value_lengths().fill_null(0), np.int64)
        at = np.concatenate([[0], np.cumsum(many)])
        return pa.array(decode(np.array(column.flatten(), np.int64), at, load(path)), pa.string())
    return F.arrow_udf(run, "string")(ids)


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for part, _, _ in chunks(batches, "text"):
            packed = encode([t or "" for t in part.column("text").to_pylist()], v)
            ids, at = _bounds(packed)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(at)), pa.array(packed, pa.binary()),
                 pa.array(decode(ids, at, v), pa.string())], ["id", "n", "packed", "back"])
    return run


def round_trip(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, n_tokens, packed ids as little-endian 32-bit integers, decoded text) of every row,
    in one pass."""
    narrow = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    coded = narrow.mapInArrow(_coded(path), f"id {kind}, n long, packed binary, back string")
    return coded.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"),
                        F.col("packed").alias("ids"), F.col("back").alias("decoded"))
