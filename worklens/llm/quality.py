"""Quality rules by repetition: characters inside duplicated n-grams and lines of a text.

Every text is hashed once; from the running sums the hash of each run of n words, for several
n, and of each line is one subtraction. A run equal to an earlier one of its text is
duplicated, and its characters count once however many duplicated runs cover them. Texts whose
symbols outnumber a tenth of their words fail as well.

Defined results: a null or empty text has no words, all counts 0 and fails the base rule; a
text of any length is taken whole; rows are judged one by one, so repeated rows, repeated or
null ids and an empty table need no case of their own; further columns of the input are passed
over, whatever their names. A run equal to its neighbour (ties) is duplicated like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded, chunks
from .words import SPACE, Repeats, Words, mix, per_text, repeats, span_hash, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of a text's word characters inside runs of n words met before.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share that the occurrences of one run of n words may have.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of characters in lines equal to an earlier line, and of such lines.
LINE_CHAR_LIMIT = 0.20
LINE_LIMIT = 0.30
#: Most symbols for each word.
SYMBOL_LIMIT = 0.1

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, gram_share double, top_share double, line_share double, "
           "line_char_share double, base_failed boolean, kept boolean")


def _duplicated(w: Words, n: int, among: np.ndarray | None) -> tuple[np.ndarray, Repeats]:
    """Starts of runs of n words, and which of them repeat within their text.

    ``among``: a run repeats only where the shorter run at its start does.
    """
    starts, found = w.gram(n, among)
    return starts, repeats(found ^ mix(w.doc[starts].astype(np.uint64) + np.uint64(1)))


def _covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of n words that begins at one of ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _lines(w: Words, point: np.ndarray):
    """Text, hash and characters of each line that has a word."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.union1d(w.at[:-1], breaks + 1)
    start = start[start < len(w.data)]
    # A break or the next text ends the line.
    end = np.concatenate([start[1:], [len(w.data)]]) if len(start) else start
    ends_in_break = w.data[end - 1] == 10 if len(end) else np.zeros(0, bool)
    end = end - ends_in_break
    inside = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    start, end = start[inside > 0], end[inside > 0]
    doc = np.searchsorted(w.at, start, "right") - 1
    return doc, span_hash(w.sums, start, end), point[end] - point[start]


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text; ``kept`` follows from the limits above."""
    w, n_texts = words(data, at), len(at) - 1
    lead = (data & 0xC0) != 0x80
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead & ~SPACE[data], out=point[1:])
    word_chars = point[at[1:]] - point[at[:-1]]
    chars = point[w.end] - point[w.start]

    doc, found, size = _lines(w, point)
    same = repeats(found ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    later = same.place[same.later]
    n_lines = np.bincount(doc, minlength=n_texts)
    n_dup_lines = np.bincount(doc[later], minlength=n_texts)
    line_chars = np.bincount(doc[later], size[later], minlength=n_texts)

    fine, gram_share, top_share = np.ones(n_texts, bool), np.zeros(n_texts), np.zeros(n_texts)
    before, among = np.concatenate([[0], np.cumsum(chars)]), None
    for n in range(2, max(GRAM_LIMITS) + 1):
        starts, same = _duplicated(w, n, among)
        among = np.sort(starts[same.place])
        if n == 3:
            n_repeat = np.bincount(w.doc[_covered(len(w.doc), among, n)], minlength=n_texts)
        if n in GRAM_LIMITS:
            inside = _covered(len(w.doc), starts[same.place[same.later]], n)
            share = _share(np.bincount(w.doc[inside], chars[inside], minlength=n_texts),
                           word_chars)
            fine &= share <= GRAM_LIMITS[n]
            gram_share = np.maximum(gram_share, share)
        if n in TOP_LIMITS:
            first, most = starts[same.first], np.zeros(n_texts)
            np.maximum.at(most, w.doc[first], same.count * (before[first + n] - before[first]))
            share = _share(most, word_chars)
            fine &= share <= TOP_LIMITS[n]
            top_share = np.maximum(top_share, share)

    line_share, line_char_share = _share(n_dup_lines, n_lines), _share(line_chars, word_chars)
    fine &= (line_share <= LINE_LIMIT) & (line_char_share <= LINE_CHAR_LIMIT)
    n_words, n_symbols = w.count, per_text(SYMBOLS[data], at)
    fine &= n_symbols <= SYMBOL_LIMIT * n_words
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": word_chars,
            "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat, "gram_share": gram_share,
            "top_share": np.minimum(top_share, 1.0), "line_share": line_share,
            "line_char_share": line_char_share, "base_failed": failed, "kept": fine & ~failed}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, at in chunks(batches, "text"):
        found = measure(data, at)
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), *(pa.array(v) for v in found.values())], ["id", *found])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the measures and whether it is ``kept``."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_judge, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)
