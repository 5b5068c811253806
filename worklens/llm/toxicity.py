"""Toxicity by misspelled lexicon terms in their context.

A lexicon of words and word beginnings is learned from labelled rows, and with it how much each
term, at each number of edits, tells about the label. The Levenshtein automata of the terms
(transpositions count as one edit) run together along the trie of the lexicon; their product is
made deterministic once, so that all words of a batch walk one table, a character a step, in
numpy, until they die. A word that a chosen beginning covers keeps the edits it would be allowed
alone; its misspellings count as the beginning's. Each hit is weighed with its context window: inside quotation marks,
near a word of reporting, near a word of address. Labels, ids, languages and sources are no
input of a score.

The lexicon is learned from at most SAMPLE labelled rows, those with the lowest hash of their
id; everything else looks at all rows.

Defined results: a null or empty text has the score of a text without hits, which is the share
of toxic rows; without labels, or without toxic ones, every score is that share and there are
no terms. Texts of any length are read whole. Repeated rows score alike, and copies of one text teach
once for each label; null ids match no label; null labels teach nothing. Further
columns are carried through by ``without_toxic`` under their own names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tables import bounded, chunks

SAMPLE = 20_000
WINDOW = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
WORD_LEAST, PREFIX_LEAST, RATIO_LEAST = 5, 20, 2.0
#: Least share of the different toxic texts that a term must occur in.
SHARE_LEAST = 0.02
THRESHOLD = 0.3
#: How a term is met in a text: once, twice or more often as it stands, with one edit, with two.
LEVELS = 5
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says wrote writes quoted quote called calls term word phrase sagte "
                      "schrieb zitat wort dit écrit mot cita dijo escribió palabra".split())
ADDRESS = frozenset("you your yours youre u ur du dich dir euch tu te toi vous tú ti usted".split())
#: Weight of a context before any label is seen: quoted, reported, addressed.
PRIOR = (-1.5, -0.75, 0.75)
PRIOR_HITS = 50.0
#: Weight of a misspelling that no labelled row has, and the least weight that counts.
UNSEEN, COUNTS = 3.0, 2.6


@dataclass
class Automaton:
    """All words near a term: ``step[state, class]``; state 0 is dead, state 1 begins."""
    classes: np.ndarray   # class of each code point
    step: np.ndarray
    term: np.ndarray      # term that a word ending here is, or -1
    edits: np.ndarray
    done: np.ndarray      # no further character changes the term


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray   # of (term, level)
    context: np.ndarray   # of the eight kinds of context
    prior: float


def allowed(term: str, prefix: bool) -> int:
    if prefix:
        return int(len(term) >= 6)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def build(terms: list[tuple[str, bool]], covered: list[tuple[str, int]] = ()) -> Automaton:
    """The product of the terms' automata with their trie, made deterministic.

    ``covered`` has words that a beginning covers, with its number: their misspellings are hits of
    that beginning. A state is a set of (trie node, edits so far, character owed by a transposition); a
    beginning that has been read whole stays in the set as (-1 - term, edits, "").
    """
    every = [*terms, *((word, False) for word, _ in covered)]
    letters = sorted({c for t, _ in every for c in t})
    nodes: list[dict[str, int]] = [{}]
    ends: dict[int, list[int]] = {}
    limit = [0]
    for number, (term, prefix) in enumerate(every):
        at, most = 0, allowed(term, prefix)
        limit[0] = max(limit[0], most)
        for c in term:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                limit.append(0)
            at = nodes[at][c]
            limit[at] = max(limit[at], most)
        ends.setdefault(at, []).append(number)

    def closed(items) -> frozenset:
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, owed = todo.pop()
            if node >= 0 and e > limit[node] or best.get((node, owed), 99) <= e:
                continue
            best[node, owed] = e
            if node >= 0 and not owed:
                for number in ends.get(node, ()):
                    term, prefix = every[number]
                    if prefix and e <= allowed(term, True):
                        todo.append((-1 - number, e, ""))
                todo += [(child, e + 1, "") for child in nodes[node].values()]
        return frozenset((n, e, o) for (n, o), e in best.items())

    def moved(state: frozenset, c: str) -> frozenset:
        out = []
        for node, e, owed in state:
            if node < 0:
                out.append((node, e, ""))
            elif owed:
                if owed == c:
                    out.append((node, e, ""))
            else:
                here = nodes[node]
                out.append((node, e + 1, ""))
                for a, child in here.items():
                    out.append((child, e + (a != c), ""))
                    if a != c and c in nodes[child]:
                        out.append((nodes[child][c], e + 1, a))
        return closed(out)

    def told(state: frozenset) -> tuple[int, int]:
        found = [(e, terms[-1 - n][1], -1 - n) for n, e, _ in state if n < 0]
        for node, e, owed in state:
            if node >= 0 and not owed:
                near = [k for k in ends.get(node, ()) if not every[k][1] and e <= allowed(*every[k])]
                # A covered word ranks as its beginning does.
                found += [(e, False, k) if k < len(terms) else (e, True, covered[k - len(terms)][1])
                          for k in near]
        return (min(found)[2], min(found)[0]) if found else (-1, 0)

    begin, dead = closed([(0, 0, "")]), frozenset()
    number = {dead: 0, begin: 1}
    states, rows = [dead, begin], []
    for state in states:  # grows on the way
        row = []
        for c in ("", *letters):
            to = moved(state, c) if state else dead
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        rows.append(row)
    classes = np.zeros(0x110000, np.int16)
    for k, c in enumerate(letters):
        classes[ord(c)] = k + 1
    answers = [told(s) for s in states]
    return Automaton(classes, np.array(rows, np.int32), np.array([a for a, _ in answers]),
                     np.array([e for _, e in answers]),
                     np.array([bool(s) and all(n < 0 for n, _, _ in s) for s in states]))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def hits(data: np.ndarray, at: np.ndarray, automaton: Automaton):
    """Text, term, edits and kind of context of every word that is near a term."""
    whole = data.tobytes()
    texts = [whole[a:b].replace(b"\0", b" ") for a, b in zip(at[:-1], at[1:])]
    text = b"\0".join(texts).decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    state = np.ones(len(start), np.int32)
    live, k = np.arange(len(start)), 0
    kinds = automaton.classes[points]
    while True:
        live = live[(size[live] > k) & (state[live] > 0) & ~automaton.done[state[live]]]
        if not len(live):
            break
        state[live] = automaton.step[state[live], kinds[start[live] + k]]
        k += 1
    found = np.flatnonzero(automaton.term[state] >= 0)
    split = np.flatnonzero(points == 0)
    doc = np.searchsorted(split, start[found], "left")
    quote = np.isin(points, [ord(c) for c in QUOTES])
    quotes = np.concatenate([[0], np.cumsum(quote)])
    opens = np.concatenate([[0], split])[doc]
    quoted = (quotes[start[found]] - quotes[opens]) % 2 == 1
    # A mark that is never closed quotes nothing.
    closes = np.concatenate([split, [len(points)]])[doc]
    quoted &= quotes[closes] > quotes[end[found]]
    context = quoted * 4
    for i, w in enumerate(found):
        near = range(max(0, w - WINDOW), min(len(start), w + WINDOW + 1))
        around = {text[start[v]:end[v]] for v in near if v != w
                  and opens[i] <= start[v] < closes[i]}
        context[i] += 2 * (not REPORTING.isdisjoint(around)) + (not ADDRESS.isdisjoint(around))
    return doc, automaton.term[state[found]], automaton.edits[state[found]], context


def levels(doc: np.ndarray, term: np.ndarray, edits: np.ndarray, context: np.ndarray,
           n_terms: int):
    """Hits as one row for each text, term and level, with the plainest context among them."""
    pair = doc * n_terms + term
    level = edits + 2
    exact = np.flatnonzero(edits == 0)
    _, group, count = np.unique(pair[exact], return_inverse=True, return_counts=True)
    level[exact] = np.minimum(count[group], 3) - 1
    key, group = np.unique(pair * LEVELS + level, return_inverse=True)
    plain = np.full(len(key), 7)
    np.minimum.at(plain, group, context)
    return key // LEVELS // n_terms, key // LEVELS % n_terms, key % LEVELS, plain


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lexicon(words: DataFrame, toxic: int,
            clean: int) -> tuple[list[tuple[str, bool]], list[tuple[str, int]]]:
    """Terms from (word, toxic rows, clean rows): all over the limits, of which SHARE_LEAST bounds
    the number by the length of the taught texts; and the words that would be allowed more edits
    than the beginning that covers them, with its number."""
    begun = words.select("toxic", "clean", F.explode(F.array(*[
        F.when(F.length("word") > k, F.substring("word", 1, k)) for k in PREFIXES])).alias("term"))
    begun = begun.filter("term is not null").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    every = words.filter((F.length("word") >= 3) & (F.col("toxic") >= WORD_LEAST)).select(
        F.col("word").alias("term"), F.lit(False).alias("prefix"), "toxic", "clean").union(
        begun.filter(F.col("toxic") >= PREFIX_LEAST).select(
            "term", F.lit(True).alias("prefix"), "toxic", "clean"))
    ratio = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    rows = every.withColumn("ratio", ratio).filter(
        (F.col("ratio") > RATIO_LEAST) & (F.col("toxic") >= SHARE_LEAST * toxic)).orderBy(
        (F.col("toxic") * F.col("ratio")).desc(), "prefix", F.length("term").desc(), "term")
    chosen: list[tuple[str, bool]] = []
    covered: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    for r in rows.collect():
        over = [k for k, (t, p) in enumerate(chosen) if p and r["term"].startswith(t)]
        if over:
            most = max(allowed(*chosen[k]) for k in over)
            if not r["prefix"] and allowed(r["term"], False) > most:
                covered.append((r["term"], over[0]))
            continue
        known = sum(n for t, n in held.items() if t.startswith(r["term"]))
        if r["prefix"] and r["toxic"] <= 1.2 * known:
            continue
        chosen.append((r["term"], r["prefix"]))
        held[r["term"]] = r["toxic"]
    return chosen, covered


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", teaches: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn terms and weights; ``teaches`` says which rows of ``labels`` may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"),
                          (F.lit(True) if teaches is None else teaches).alias("teaches"))
    known = known.filter("teaches and toxic is not null and id is not null").select("id", "toxic")
    known = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    # At most ``sample`` rows of two numbers.
    taught = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), "id")
    # Copies of one text teach once.
    taught = cut(taught.select("toxic", "text").distinct(), "toxic-sample")
    split = taught.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    counts = split.groupBy("word").agg(F.sum("toxic").alias("toxic"),
                                       F.sum(1 - F.col("toxic")).alias("clean"))
    size = taught.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic, clean = size["toxic"] or 0, size["n"] - (size["toxic"] or 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5)) if size["n"] else math.log(0.05)
    terms, covered = lexicon(cut(counts, "toxic-words"), toxic, max(1, clean)) if toxic else ([], [])
    if not terms:
        return Model(None, np.zeros((0, LEVELS)), np.zeros(8), prior)
    automaton = build(terms, covered)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in chunks(batches, "text"):
            doc, *seen = levels(*hits(data, at, automaton), len(terms))
            label = np.array(part.column("toxic"))[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32)) for c in (label, *seen)],
                ["toxic", "term", "level", "context"])

    seen = taught.select("toxic", F.col("text").cast("binary").alias("text")).mapInArrow(
        found, "toxic int, term int, level int, context int")
    rows = seen.groupBy("toxic", "term", "level", "context").count().collect()  # 80 a term at most
    by_term, by_context = np.zeros((2, len(terms), LEVELS)), np.zeros((2, 8))
    for r in rows:
        by_term[r["toxic"], r["term"], r["level"]] += r["count"]
        by_context[r["toxic"], r["context"]] += r["count"]
    weights = np.log((by_term[1] + 0.25) / max(1, toxic)) - np.log((by_term[0] + 0.25) / max(1, clean))
    weights[by_term.sum(0) == 0] = np.where(np.arange(LEVELS) < 3, 0.0, UNSEEN)[
        np.nonzero(by_term.sum(0) == 0)[1]]
    weights[:, 1:3] = np.maximum(weights[:, 1:3], weights[:, :1])  # more hits tell no less
    prior_of = np.array([sum(p for p, bit in zip(PRIOR, (4, 2, 1)) if k & bit) for k in range(8)])
    share = [(by_context[k] + PRIOR_HITS / 8) / (by_context[k].sum() + PRIOR_HITS) for k in (0, 1)]
    return Model(automaton, weights, prior_of + np.log(share[1]) - np.log(share[0]), prior)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(texts), model.prior)
    if model.automaton is not None:
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["k", "text"])
        for part, data, at in chunks(iter([batch]), "text"):
            doc, term, level, context = levels(*hits(data, at, model.automaton), len(model.weights))
            worth = model.weights[term, level]
            worth = worth + np.where(worth > 0, model.context[context], 0.0)
            # The best level of a term counts for its text.
            pair, place = np.unique(doc * len(model.weights) + term, return_inverse=True)
            best = np.full(len(pair), -np.inf)
            np.maximum.at(best, place, worth)
            rows = np.array(part.column("k"))
            out[rows] += np.bincount(pair // len(model.weights), np.where(
                best >= COUNTS, best, 0.0), minlength=len(rows))
    return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def score(text: Column, model: Model) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model), pa.float64())
    return F.arrow_udf(run, "double")(F.coalesce(text.cast("binary"), F.lit(b"")))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Id, whether the row was held out, its score and the verdict, for each row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, teaches=~held_out(F.col(id_col)))
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                       score(F.col(text_col), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, columns unchanged."""
    return bounded(docs).filter(score(F.col(text_col), model) < threshold)
