"""Repeated passages by relative factoring: documents against blocks of indexed windows.

A window is WINDOW consecutive words of one document. Its lowest run is the run of GRAM words in
it with the lowest hash (the rightmost of equal ones). Every window is filed under its anchor:
the WIDE words that begin with the lowest run where that stands in the window's first half, and
that end with it otherwise; these all lie in the window. So equal windows are filed under equal
anchors, neighbouring windows mostly share one, and a common phrase of fewer than WIDE words is
told apart by what stands beside it. A row holds an anchor, a stretch of neighbouring windows and
a hash of each. The rows are dealt by anchor into blocks, the reference. In a block, each window whose words also start earlier is matched
with the earliest place there. A document is then factored greedily: a factor goes on while its
windows match places that follow one another in one earlier document; where it breaks off, the
windows across the boundary are looked up on their own like all others, so that none is lost.
Words inside a factor of at least WINDOW words are removed. What is earlier is judged on the
input: by id, then by place.

Before rows are dealt, a window that an earlier row of the same chunk holds is matched there
and not sent, so a passage that a third of all documents share reaches its block once a chunk.

Defined results: a null text has no words; a document shorter than a window keeps all its
words; texts are read whole; rows with a null id serve as no reference and keep all words;
rows that repeat an id are one document, so equal rows are no repeat of each other and rows of
one id share their spans; an empty table gives an empty result; further columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, chunks
from .words import mix, words

WINDOW = 20
GRAM = 5
#: Half the places that a run of GRAM words has in a window, and the words of an anchor.
HALF = (WINDOW - GRAM + 1) // 2
WIDE = GRAM + HALF
#: Bytes kept of a window's hash; under one anchor they tell windows apart.
HASH_BYTES = 6
STRETCH = "anchor long, id long, start int, n int, hashes binary, ref_id long, ref_start int"
SPAN = "id long, start int, n int, ref_id long, ref_start int"


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest of each ``width`` (a power of two) neighbours, rightmost of equals."""
    low, place, step = hashes, np.arange(len(hashes)), 1
    while step < width and len(low) > step:
        right = low[step:] <= low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, low[step:], low[:-step])
        step *= 2
    return place


def earlier(keys: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """Which windows equal an earlier one, and the earliest place of each of those."""
    bits = max(10, (4 * len(keys)).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    place = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    place = place[np.lexsort((starts[place], ids[place], keys[place]))]
    found = keys[place]
    opens = np.ones(len(found), bool)
    opens[1:] = found[1:] != found[:-1]
    first = place[np.maximum.accumulate(np.where(opens, np.arange(len(found)), 0))]
    later = (ids[first] != ids[place]) | (starts[first] != starts[place])
    return place[later], first[later]


def stretches(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a new stretch begins among windows in order: of one document, next to each other,
    alike in ``same``."""
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        opens[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(opens)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _spans(ids, starts, ref_ids, ref_starts):
    """Matched windows in order as spans: (first window, number, first matched place)."""
    begin = stretches(ids, starts, ref_ids, ref_starts - starts)
    n = np.diff(np.concatenate([begin, [len(ids)]]))
    return ids[begin], starts[begin], n, ref_ids[begin], ref_starts[begin]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows under their anchors, and spans already known to be repeats."""
    for part, data, at in chunks(batches, "text"):
        w = words(data, at)
        s, window = w.gram(WINDOW)
        if not len(s):
            continue
        runs = np.full(len(w.doc), np.uint64(2**64 - 1))
        g, hashes = w.gram(GRAM)
        runs[g] = hashes
        place = anchors(runs, WINDOW - GRAM + 1)[s]
        place = np.where(place - s < HALF, place, place - HALF)
        wide = np.zeros(len(w.doc), np.uint64)
        g, hashes = w.gram(WIDE)
        wide[g] = hashes
        doc = w.doc[s]
        start = s - w.first[doc]
        ids = np.array(part.column("id"))[doc]
        later, first = earlier(window, ids, start)
        order = np.argsort(later)
        later, first = later[order], first[order]
        span = _spans(ids[later], start[later], ids[first], start[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(span[0].astype(np.uint64)).view(np.int64)), pa.array(span[0]),
             pa.array(span[1].astype(np.int32)), pa.array(span[2].astype(np.int32)),
             pa.nulls(len(span[0]), pa.binary()), pa.array(span[3]),
             pa.array(span[4].astype(np.int32))],
            ["anchor", "id", "start", "n", "hashes", "ref_id", "ref_start"])
        kept = np.ones(len(s), bool)
        kept[later] = False
        kept = np.flatnonzero(kept)
        begin = stretches(doc[kept], start[kept], place[kept])
        n = np.diff(np.concatenate([begin, [len(kept)]]))
        head = kept[begin]
        short = window[kept].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array(wide[place[head]].view(np.int64)), pa.array(ids[head]),
             pa.array(start[head].astype(np.int32)), pa.array(n.astype(np.int32)),
             _binary(np.ascontiguousarray(short), n * HASH_BYTES), pa.nulls(len(n), pa.int64()),
             pa.nulls(len(n), pa.int32())],
            ["anchor", "id", "start", "n", "hashes", "ref_id", "ref_start"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a block's windows that start earlier too; rows come in order of the anchor.

    What is carried from batch to batch is the earliest places of the last anchor alone."""
    last, keys0 = None, np.zeros(0, np.uint64)
    ids0 = starts0 = np.zeros(0, np.int64)
    names = ["id", "start", "n", "ref_id", "ref_start"]
    for batch in batches:
        known = batch.filter(batch.column("ref_id").is_valid())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(c) for c in names], names)
        batch = batch.filter(batch.column("hashes").is_valid())
        if not batch.num_rows:
            continue
        anchor, ids, start, n = (np.array(batch.column(c)) for c in ("anchor", "id", "start", "n"))
        hashes = batch.column("hashes")
        _, offsets, values = hashes.buffers()
        offsets = np.frombuffer(offsets, np.int32)[hashes.offset:hashes.offset + len(hashes) + 1]
        raw = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]].reshape(-1, HASH_BYTES)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :HASH_BYTES] = raw
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        keys = mix(full.view(np.uint64)[:, 0] ^ mix(anchor.view(np.uint64))[row])
        id_, at = ids[row], start[row].astype(np.int64) + step
        if last is None or anchor[0] != last:
            keys0, ids0, starts0 = keys0[:0], ids0[:0], starts0[:0]
        c = len(keys0)
        keys, id_, at = (np.concatenate(x) for x in ((keys0, keys), (ids0, id_), (starts0, at)))
        later, first = earlier(keys, id_, at)
        order = np.lexsort((at[later], id_[later]))
        later, first = later[order], first[order]
        own = later >= c
        later, first = later[own], first[own]
        if len(later):
            found = _spans(id_[later], at[later], id_[first], at[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(t)) for x, t in zip(
                    found, (np.int64, np.int32, np.int32, np.int64, np.int32))], names)
        last = anchor[-1]
        keep = np.concatenate([np.full(c, anchor[0] == last), (anchor == last)[row]])
        keep[later] = False
        keep = np.flatnonzero(keep)
        keys0, ids0, starts0 = keys[keep], id_[keep], at[keep]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n, ref_id, ref_start): n windows from word ``start`` on, each of which also
    starts earlier, at its place from ``ref_start`` on in ``ref_id``."""
    narrow = bounded(docs).filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    filed = narrow.mapInArrow(_index, STRETCH)
    blocks = filed.repartition("anchor").sortWithinPartitions("anchor", "id", "start")
    return blocks.mapInArrow(_match, SPAN)


def factored(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, ref_id, ref_start) from a document's spans."""
    out: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x["start"], -x["n"])):
        a, b = x["start"], x["start"] + x["n"] + WINDOW - 1
        if out:
            f = out[-1]
            end = f[0] + f[1]
            if b <= end:
                continue
            # The same earlier document goes on at the same distance.
            if x["ref_id"] == f[2] and x["ref_start"] - a == f[3] - f[0] and a <= end:
                f[1] = b - f[0]
                continue
        out.append([a, b - a, x["ref_id"], x["ref_start"]])
    return [tuple(f) for f in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, at in chunks(batches, "text"):
        whole = data.tobytes()
        n_words, n_removed, kept, factors = [], [], [], []
        for k, found in enumerate(part.column("found").to_pylist()):
            own = whole[at[k]:at[k + 1]].split()
            fs = factored(found) if found else []
            if fs:
                gone = np.zeros(len(own) + 1, np.int64)
                np.add.at(gone, [f[0] for f in fs], 1)
                np.add.at(gone, [f[0] + f[1] for f in fs], -1)
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                left = [own[i] for i in left]
            else:
                left = own
            n_words.append(len(own))
            n_removed.append(len(own) - len(left))
            kept.append(b" ".join(left))
            factors.append([dict(zip(("start", "words", "ref_id", "ref_start"), f)) for f in fs])
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()), pa.array(factors, pa.list_(pa.struct(
                 [("start", pa.int32()), ("words", pa.int32()), ("ref_id", pa.int64()),
                  ("ref_start", pa.int32())])))],
            ["id", "n_words", "n_removed", "kept", "factors"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, words, removed words, the kept words joined by spaces, and the factors."""
    found = spans(docs, id_col, text_col).groupBy("id").agg(F.collect_list(
        F.struct("start", "n", "ref_id", "ref_start")).alias("found"))
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.join(found, rows["own_id"].cast("long") == found["id"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(F.col("own_id").alias("id"), "text", "found").mapInArrow(
        _remove, f"id {kind}, n_words long, n_removed long, kept binary, factors array<struct<"
                 "start:int,words:int,ref_id:bigint,ref_start:int>>").select(
        F.col("id").alias(id_col), "n_words", "n_removed",
        F.col("kept").cast("string").alias("kept"), "factors")
