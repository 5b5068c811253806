"""SentencePiece encoding by a streaming Viterbi search, and decoding.

A text is a space in front, every space written as U+2581, and is cut into pieces of the given
vocabulary such that the sum of the pieces' scores is largest; among equal sums the longer last
piece wins. A code point that no chosen piece covers is written as its UTF-8 bytes, each byte a
piece of its own, at a score below that of any piece.

The search runs forward over the code points and keeps, for a window of the longest piece, the
best sum and backpointer of each boundary. As soon as all boundaries of the window go back to
one common boundary, the pieces up to it are fixed: their ids are given out and forgotten, so
what is held does not grow with the text. Most such points are where no piece can reach over:
before a space mark that follows another character, if no piece has one inside. The text
between two such points is searched in step with all others of a batch, in numpy, and its ids
are remembered for a bounded number of stretches.

Decoding joins the pieces, with runs of byte pieces read as UTF-8, turns marks into spaces and
drops the space in front. Round trip: exact for every text without U+2581, which reads back as
a space. Defined results: a null or empty text has no ids and decodes to empty text; texts of
any length are read whole; repeated rows, null ids and empty tables need no case; ``with_ids``
keeps further columns under their own names, and replaces one named as its output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded, chunks
from .words import BASE, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How far a byte piece lies under the lowest score of the vocabulary.
BYTE_PENALTY = 10.0
#: Longest stretch between two cuts that is searched in step with others.
IN_STEP = 48
CHUNK_POINTS = 1_500_000


class Memory:
    """Ids of stretches met before, by the hash of the stretch; at most ``most`` of them."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.keys = np.zeros(0, np.uint64)
        self.at = self.many = self.ids = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each key begin and how many they are (-1: unknown); all ids."""
        at, many = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[place] == keys
            at[known], many[known] = self.at[place[known]], self.many[place[known]]
        return at, many, self.ids

    def add(self, keys: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            return
        at = np.concatenate([self.at, bounds[:-1] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        many = np.concatenate([self.many, np.diff(bounds)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.at, self.many = keys[order], at[order], many[order]


_MEMORY: dict[str, Memory] = {}


@dataclass
class Vocabulary:
    pieces: dict[str, int]      # without control and byte pieces
    score: np.ndarray           # by id
    byte: np.ndarray            # id of each byte
    byte_score: float
    longest: int
    splits: bool                # no piece has a mark after another character
    raw: list[bytes]            # what each id stands for, b"" for control pieces
    keys: list[np.ndarray]      # by length: hashes of the pieces, sorted
    ids: list[np.ndarray]       # and their ids
    name: str

    @property
    def memory(self) -> Memory:
        """Kept by the worker process from task to task."""
        return _MEMORY.setdefault(self.name, Memory())


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    score = np.array([model.get_score(i) for i in range(size)])
    pieces, raw, byte = {}, [b""] * size, np.full(256, -1)
    for i in range(size):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(p[1:-1], 16)] = i
            raw[i] = bytes([int(p[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[p] = i
            raw[i] = p.encode()
    if (byte < 0).any():
        raise ValueError("the vocabulary needs a piece for each byte")
    longest = max(map(len, pieces))
    keys, ids = [], []
    for n in range(longest + 1):
        of_length = sorted((_hash(p), i) for p, i in pieces.items() if len(p) == n)
        keys.append(np.array([h for h, _ in of_length], np.uint64))
        ids.append(np.array([i for _, i in of_length], np.int64))
    low = min(float(score[i]) for i in pieces.values())
    return Vocabulary(pieces, score, byte, low - BYTE_PENALTY, longest,
                      all(MARK not in p.lstrip(MARK) for p in pieces), raw, keys, ids, path)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more code point each."""
    return mix(h * BASE + points.astype(np.uint64) + np.uint64(1))


def _hash(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for point in _points(piece):
        h = _longer(h, np.array([point]))
    return int(h[0])


def stream(text: str, v: Vocabulary) -> Iterator[int]:
    """Ids of a text with marks, given out as soon as they are certain."""
    # Boundaries from ``base`` on: best sum, where the last piece begins, its id (-1: bytes).
    base, sums, back, last = 0, [0.0], [0], [0]
    for end in range(1, len(text) + 1):
        best, begin, piece = sums[end - 1 - base] + v.byte_score * len(
            text[end - 1].encode("utf-8", "replace")), end - 1, -1
        for start in range(end - 1, max(base, end - v.longest) - 1, -1):
            number = v.pieces.get(text[start:end])
            if number is not None and sums[start - base] + v.score[number] >= best:
                best, begin, piece = sums[start - base] + v.score[number], start, number
        sums.append(best)
        back.append(begin)
        last.append(piece)
        # The boundaries that a later piece can begin at; where do their paths meet?
        if end % v.longest and end < len(text):
            continue
        open_ends = set(range(max(base, end - v.longest + 1), end + 1)) \
            if end < len(text) else {end}
        while len(open_ends) > 1:
            far = max(open_ends)
            open_ends.remove(far)
            open_ends.add(back[far - base] if far > base else base)
        meet = open_ends.pop()
        if meet > base:
            path, at = [], meet
            while at > base:
                path.append((back[at - base], at, last[at - base]))
                at = back[at - base]
            for a, b, number in reversed(path):
                yield from (int(v.byte[x]) for x in text[a:b].encode("utf-8", "replace")) \
                    if number < 0 else (number,)
            sums, back, last = sums[meet - base:], back[meet - base:], last[meet - base:]
            base = meet


def _in_step(points: np.ndarray, start: np.ndarray, size: np.ndarray,
             v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many stretches of code points: all ids, and where those of each begin."""
    n, total, most = len(start), len(points), int(size.max())
    # Code points one after another; a stretch sees no further than its end.
    own = np.repeat(np.arange(n), size)
    offset = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offset[-1]) - offset[own]
    flat = points[start[own] + place]
    left = size[own] - place
    width = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4)))
    best = np.full((n, most + 1), -np.inf)
    back = np.zeros((n, most + 1), np.int32)
    last = np.full((n, most + 1), -1, np.int32)
    best[:, 0] = 0.0
    found, h = [], np.zeros(len(flat), np.uint64)
    for k in range(1, min(v.longest, most) + 1):
        stop = len(flat) - k + 1
        h = _longer(h[:stop], flat[k - 1:])
        ok = np.flatnonzero(left[:len(h)] >= k)
        if not len(v.keys[k]) or not len(ok):
            continue
        at = np.searchsorted(v.keys[k], h[ok])
        at[at == len(v.keys[k])] = 0
        ok, at = ok[v.keys[k][at] == h[ok]], at[v.keys[k][at] == h[ok]]
        number = v.ids[k][at]
        found.append((place[ok] + k, own[ok], place[ok], number))
    bytes_at = np.arange(len(flat))
    found.insert(0, (place + 1, own[bytes_at], place, np.full(len(flat), -1)))
    end, row, begin, number = (np.concatenate(x) for x in zip(*found))
    worth = np.where(number >= 0, v.score[number], 0.0)
    worth[:len(flat)] = v.byte_score * width
    # By end, then shorter pieces first: a longer piece of the same sum replaces them.
    order = np.lexsort((end - begin, end))
    end, row, begin, number, worth = (x[order] for x in (end, row, begin, number, worth))
    length = end - begin + (number >= 0) * 0
    cuts = np.searchsorted(end, np.arange(1, most + 2))
    for e in range(1, most + 1):
        a, b = cuts[e - 1], cuts[e]
        steps = np.searchsorted(length[a:b], np.arange(1, v.longest + 2)) + a
        for x, y in zip(steps[:-1], steps[1:]):
            if x == y:
                continue
            # Of one length there is one piece a stretch, besides the bytes of one code point.
            for part in (slice(x, y),) if length[x] > 1 else _split(number, x, y):
                r, s = row[part], best[row[part], begin[part]] + worth[part]
                better = s >= best[r, e]
                r = r[better]
                best[r, e] = s[better]
                back[r, e] = begin[part][better]
                last[r, e] = number[part][better]
    # Back along all paths at once, then the other way round.
    at, rows, steps = size.copy(), np.arange(n), []
    while len(rows):
        a = at[rows]
        steps.append((rows, back[rows, a], last[rows, a]))
        at[rows] = back[rows, a]
        rows = rows[at[rows] > 0]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    row = np.concatenate([s[0] for s in steps])
    begin = np.concatenate([s[1] for s in steps])
    number = np.concatenate([s[2] for s in steps]).astype(np.int64)
    order = np.lexsort((begin, row))
    row, begin, number = row[order], begin[order], number[order]
    raw = number < 0
    times = np.where(raw, width[offset[row] + begin], 1)
    ids = np.repeat(number, times)
    where = np.repeat(np.arange(len(row)), times)
    nth = np.arange(len(ids)) - np.concatenate([[0], np.cumsum(times)])[where]
    for k in np.flatnonzero(ids < 0).tolist():
        w = where[k]
        ids[k] = v.byte[chr(flat[offset[row[w]] + begin[w]]).encode("utf-8", "replace")[nth[k]]]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(row, times, minlength=n))]).astype(np.int64)


def _split(number: np.ndarray, x: int, y: int):
    """Bytes before pieces, among runs of one code point."""
    raw = np.flatnonzero(number[x:y] < 0) + x
    own = np.flatnonzero(number[x:y] >= 0) + x
    return [p for p in (raw, own) if len(p)]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_all(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where those of each text begin."""
    if not v.splits:
        each = [list(stream(marked(t), v)) for t in texts]
        return (np.array([i for e in each for i in e], np.int64),
                np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64))
    lines = [marked(t) for t in texts]
    points = _points("".join(lines))
    opens = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    mark = points == ord(MARK)
    cut = np.zeros(len(points) + 1, bool)
    cut[1:-1] = mark[1:] & ~mark[:-1]
    cut[opens] = True
    start = np.flatnonzero(cut[:-1])
    end = np.concatenate([start[1:], [len(points)]])
    size = end - start
    # Equal stretches have equal ids.
    keys = np.zeros(len(start), np.uint64)
    for k in range(int(min(IN_STEP, size.max()))):
        live = size > k
        keys[live] = _longer(keys[live], points[start[live] + k])
    long = np.flatnonzero(size > IN_STEP)
    keys[long] = mix(np.uint64(2**63) + long.astype(np.uint64))
    distinct, first, group = np.unique(keys, return_index=True, return_inverse=True)
    at, many, ids = v.memory.find(distinct)
    total, ids = len(ids), [ids]
    new = many < 0
    for part in _parts(np.flatnonzero(new & (size[first] <= IN_STEP)), size[first]):
        got, bounds = _in_step(points, start[first[part]], size[first[part]], v)
        v.memory.add(distinct[part], bounds, got)
        at[part], many[part] = total + bounds[:-1], np.diff(bounds)
        ids.append(got)
        total += len(got)
    whole = None
    for g in np.flatnonzero(size[first] > IN_STEP):
        whole = whole if whole is not None else "".join(lines)
        a = first[g]
        got = np.fromiter(stream(whole[start[a]:end[a]], v), np.int64)
        at[g], many[g] = total, len(got)
        ids.append(got)
        total += len(got)
    ids = np.concatenate(ids)
    count = many[group]
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = ids[np.repeat(at[group] - bounds[:-1], count) + np.arange(bounds[-1])]
    return out, bounds[np.searchsorted(start, opens)]


def _parts(rows: np.ndarray, size: np.ndarray, most: int = 40_000) -> Iterator[np.ndarray]:
    """Stretches of like lengths together, a bounded number at a time."""
    rows = rows[np.argsort(size[rows], kind="stable")]
    for k in range(0, len(rows), most):
        yield rows[k:k + most]


def decode(ids, v: Vocabulary) -> str:
    return b"".join(map(v.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


def encoded(text: Column, v: Vocabulary) -> Column:
    """Column of the ids of a text column."""
    def run(texts: pa.Array) -> pa.Array:
        values, out, begin = texts.to_pylist(), [], 0
        while begin < len(values):
            end, points = begin, 0
            while end < len(values) and (end == begin or points < CHUNK_POINTS):
                points += len(values[end] or "")
                end += 1
            ids, at = encode_all([t or "" for t in values[begin:end]], v)
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)),
                                                pa.array(ids.astype(np.int32))))
            begin = end
        return pa.chunked_array(out, pa.list_(pa.int32())).combine_chunks() if out else \
            pa.array([], pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")(text)


def with_ids(docs: DataFrame, text_col: str = "text", out: str = "ids",
             path: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text; a column of that name is replaced."""
    return bounded(docs).withColumn(out, encoded(F.col(text_col), load(path)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path: str = MODEL) -> DataFrame:
    """Id, ids, their number, and whether decoding gives the text back, for each row."""
    v = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in chunks(batches, "text"):
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            ids, bounds = encode_all(texts, v)
            exact = [decode(ids[a:b].tolist(), v) == t.replace(MARK, " ")
                     for a, b, t in zip(bounds[:-1], bounds[1:], texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(
                    pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                 pa.array(np.diff(bounds)), pa.array(exact, pa.bool_())],
                ["id", "ids", "n_ids", "exact"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_ids long, exact boolean").select(
        F.col("id").alias(id_col), "ids", "n_ids", "exact")
