"""Near duplicates: DartMinHash signatures, a banded join, checked links and their components.

A text's elements are its runs of five words (letters, digits and bytes above 0x7F, in lower
case), weighted by how often they occur; a shorter text is one element. Darts are thrown, by
hash alone, into the region that each element spans: unit strips of weight, along which darts
follow one another at exponential distances of rank. A dart belongs to one of COORDINATES; the
earliest dart of each coordinate is the signature, and two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. Throwing stops at the rank that fills the
coordinates on average and is doubled for texts that have an empty one.

Texts with the same weighted elements are one node, so copies are settled first. BANDS bands of
ROWS coordinates make buckets. Links are then checked exactly, on the elements:

1. In each bucket the most central node (whose buckets hold most) is the lead, and is compared
   with every other member. Components of the links are found by hooking and pointer jumping.
2. Where the members of a lead are still in different components, they are joined exactly,
   without comparing all pairs: their elements are ordered by the number of such members that
   hold them, rarest first, and two nodes at least THRESHOLD alike must share one among the
   first few of both (prefix and positional filters, with the bound of their two sizes). An
   element that only one component has joins nothing. Candidates are compared and components
   found anew.

So every two members of a bucket that are THRESHOLD alike end in one class; a pair at 0.8 shares
no bucket at all with a probability of 7e-5, one at 0.9 with 1e-9.

Defined results: a null or empty text, or one without words, is in one class with texts of the
same bytes; texts are read whole; repeated rows are in one class; rows with a null id are in
the class of an equal text with an id, else in none (null); ties go to the smaller id; an empty
table gives an empty result; ``without_near_copies`` carries further columns along.
Elements are compared by 32 bits of their hashes, which moves a similarity by 1e-4 at most for
texts of up to 400,000 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tables import bounded, chunks, raw
from .words import mix, repeats, span_hash, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Darts that a text gets on average.
DARTS = COORDINATES * (np.log(COORDINATES) + 2.0)
GOLD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def elements(data: np.ndarray, at: np.ndarray):
    """Text and 64 bits of every unit of weight: the k-th occurrence of a run is its k-th unit."""
    w = words(LOWER[data], at, BETWEEN)
    starts, h = w.gram(SHINGLE)
    few = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    short = mix(span_hash(w.word_sums, w.first[few], w.first[few + 1]) + GOLD)
    doc, h = np.concatenate([w.doc[starts], few]), np.concatenate([h, short])
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    same = repeats(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    begin = np.flatnonzero(~same.later)
    nth = np.arange(len(same.place)) - np.repeat(begin, np.diff(np.append(begin, len(same.place))))
    units = h.copy()
    # The first unit of a run is the same whether or not the run comes again.
    units[same.place] = np.where(same.later, mix(h[same.place] + nth.astype(np.uint64) * GOLD),
                                 h[same.place])
    return doc, units, w


def throw(doc: np.ndarray, units: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures of ``n_docs`` texts, each with at least one unit."""
    out = np.zeros((n_docs, COORDINATES), np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    limit = np.divide(DARTS, weight, where=weight > 0, out=np.zeros(n_docs))
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        rank, thrown = np.zeros(len(live)), 0
        low = np.full(n_docs * COORDINATES, np.inf)
        found = []
        while len(live):
            # Several darts at once where few strips are left.
            k = int(np.clip(100_000 // len(live), 1, 256))
            number = np.arange(thrown + 1, thrown + k + 1, dtype=np.uint64)
            dart = mix(units[live, None] + number * GOLD)
            gap = -np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            ranks = rank[:, None] + np.cumsum(gap, axis=1)
            hit = ranks < limit[doc[live], None]
            rank, thrown = ranks[:, -1], thrown + k
            last = hit[:, -1]
            row, col = np.nonzero(hit)
            name = mix(dart[row, col] ^ GOLD)
            place = doc[live[row]] * COORDINATES + (name >> np.uint64(33)).astype(np.int64) % COORDINATES
            np.minimum.at(low, place, ranks[row, col])
            found.append((place, ranks[row, col], name))
            live, rank = live[last], rank[last]
        place, ranks, name = (np.concatenate(x) for x in zip(*found))
        won = ranks == low[place]
        filled = np.isfinite(low).reshape(n_docs, COORDINATES).all(axis=1)
        flat = np.zeros(n_docs * COORDINATES, np.uint64)
        flat[place[won]] = name[won]
        done = todo & filled
        out[done] = flat.reshape(n_docs, COORDINATES)[done]
        todo &= ~filled
        limit[todo] *= 2
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    cells = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, cells.shape[:2])
    for k in range(ROWS):
        h = mix(h + cells[:, :, k])
    return h


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _keys(doc: np.ndarray, units: np.ndarray, w, n: int) -> np.ndarray:
    """128 bits of each text's weighted elements; of its bytes if it has none."""
    bare = w.count == 0
    pair = []
    for salt in (np.uint64(1), np.uint64(2)):
        key = mix(_sums(mix(units ^ mix(np.full(1, salt))), doc, n) + salt)
        own = span_hash(w.sums, w.at[:-1], w.at[1:]) + salt * np.diff(w.at).astype(np.uint64)
        pair.append(np.where(bare, mix(own ^ np.uint64(2**63)), key))
    return np.stack(pair, axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, at in chunks(batches, "text"):
        n = len(at) - 1
        doc, units, w = elements(data, at)
        b = bands(throw(doc, units, n)).view(np.int64)
        weight = np.bincount(doc, minlength=n)
        some = weight > 0
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)),
            pa.array(b[some].ravel()))
        keys = pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(
            _keys(doc, units, w, n).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), keys, pa.array(weight.astype(np.int64)), lists],
            ["id", "key", "n", "bands"])


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, bands) of every row: its set of elements, their weight and the band hashes."""
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("id"),
                         F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_signed, "id long, key binary, n long, bands array<long>")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, at in chunks(batches, "text"):
        n = len(at) - 1
        doc, units, w = elements(data, at)
        keys = _keys(doc, units, w, n)
        short = (mix(units) >> np.uint64(32)).astype(np.uint32)
        short = short[np.lexsort((short, doc))]
        bounds = np.searchsorted(doc, np.arange(n + 1))
        wanted = part.column("key").to_pylist()
        rows = [k for k in range(n) if keys[k].tobytes() == wanted[k]]
        yield pa.RecordBatch.from_arrays(
            [part.column("node").take(pa.array(rows, pa.int64())),
             pa.array([short[bounds[k]:bounds[k + 1]].tobytes() for k in rows], pa.binary())],
            ["node", "units"])


def _both(one: bytes, two: bytes) -> int:
    a, b = np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32)
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum()) if len(b) else 0


def likeness(one, two):
    """Column of Jaccard similarities of two columns of units."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()
            shared = _both(x, y)
            out.append(shared / max(1, (len(x) + len(y)) // 4 - shared))
        return pa.array(out, pa.float64())
    return F.arrow_udf(run, "double")(one, two)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): the smallest node of each component.

    Every root hooks to its smallest neighbouring root; pointer jumping makes the hooks flat;
    links are rewritten to the roots, and what still joins two roots goes to the next round.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter("a < b").distinct(), "near-links")
    roots = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                .withColumn("root", F.col("node")), "near-roots")
    while not links.isEmpty():
        up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = cut(up.join(above, "up", "left").select(
                "node", F.coalesce("over", "up").alias("up"),
                F.col("over").isNotNull().alias("moved")), "near-hooks")
            if up.filter("moved").isEmpty():
                break
            up = up.select("node", "up")
        up = up.select(F.col("node").alias("root"), "up")
        roots = cut(roots.join(up, "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")), "near-roots")
        ends = links
        for c in ("a", "b"):
            ends = ends.join(up.select(F.col("root").alias(c), F.col("up").alias(f"{c}_up")), c,
                             "left").withColumn(c, F.coalesce(f"{c}_up", c)).drop(f"{c}_up")
        links = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a < b").distinct(), "near-links")
    return roots


def _compared(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) with their likeness; the units of b travel to those of a."""
    second = pairs.join(units.select(F.col("node").alias("b"), F.col("units").alias("units_b")), "b")
    both = second.join(units.select(F.col("node").alias("a"), F.col("units").alias("units_a")), "a")
    return both.select("a", "b", likeness(F.col("units_a"), F.col("units_b")).alias("like"))


def prefix(n: int, other: float, threshold: float) -> int:
    """Of ``n`` ordered units, how many are sure to hold one shared with a set of at least
    ``other`` units that is as alike as ``threshold``."""
    need = int(np.ceil(threshold / (1 + threshold) * (n + other) - 1e-9))
    return max(0, n - need + 1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column("units"))
        node, root = (pa.array(np.repeat(np.array(batch.column(c)), np.diff(at) // 4))
                      for c in ("node", "root"))
        yield pa.RecordBatch.from_arrays(
            [node, root, pa.array(np.frombuffer(data.tobytes(), np.int32))], ["node", "root", "unit"])


def _prefixes(threshold: float):
    """The units of each node's longest prefix, that of its smallest partners, with their places;
    each unit once, and only those that another component has too. How much of it counts for a
    larger partner follows from the places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, n = (np.array(batch.column(c)) for c in ("node", "root", "n"))
            row, unit, place = [], [], []
            for k in range(batch.num_rows):
                own = batch.column("own")[k].values
                m = prefix(n[k], threshold * n[k], threshold)
                at = np.flatnonzero(np.array(own.field("parts"))[:m])
                place.append(at)
                unit.append(np.array(own.field("unit"))[at])
                row.append(np.full(len(at), k))
            if not row:
                continue
            row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (node[row], root[row], n[row], np.concatenate(unit),
                                       np.concatenate(place))],
                ["node", "root", "n", "unit", "place"])
    return run


def _rest(stars: DataFrame, roots: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) in different components, among the members of leads whose members
    are not all in one."""
    own = stars.select(F.col("a").alias("lead"), F.col("b").alias("node"), "n").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = own.groupBy("lead").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    near = cut(own.join(split.filter("x < y").select("lead"), "lead", "left_semi").select(
        "node", "root", "n").distinct(), "near-members")
    each = units.join(near.select("node", "root"), "node").select("node", "root", "units").mapInArrow(
        _each, "node long, root long, unit int")
    held = each.groupBy("unit").agg(F.count(F.lit(1)).alias("df"),
                                    (F.min("root") < F.max("root")).alias("parts"))
    ordered = each.join(held, "unit").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "unit", "parts"))).alias("own"))
    marks = cut(ordered.join(near, "node").mapInArrow(
        _prefixes(threshold), "node long, root long, n long, unit int, place long"), "near-prefixes")
    # What only one component holds parts nothing.
    shared = marks.groupBy("unit").agg(
        F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("unit")
    marks = cut(marks.join(shared, "unit"), "near-shared")
    one, two = marks.alias("p"), marks.alias("q")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("p.n") + F.col("q.n")) - F.lit(1e-9))
    # Both must have the unit early enough, and from there on enough of what is still to share.
    rest = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    on = ((F.col("p.unit") == F.col("q.unit"))
          & (F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root"))
          & (F.col("p.place") <= F.col("p.n") - need) & (F.col("q.place") <= F.col("q.n") - need)
          & (rest + F.least("p.place", "q.place") >= need)
          & (F.least("p.n", "q.n") >= F.lit(threshold) * F.greatest("p.n", "q.n")))
    return one.join(two, on).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: its id, the class (its smallest id), and how many checked links its
    text has that were needed to tell the class."""
    rows = cut(signed(docs, id_col, text_col), "near-signed")
    nodes = cut(rows.groupBy("key").agg(F.min("id").alias("node"), F.first("n").alias("n"),
                                        F.first("bands").alias("bands")), "near-nodes")
    filed = nodes.filter("node is not null").select("node", "n", F.explode("bands").alias("bucket"))
    full = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    filed = cut(filed.join(full, "bucket"), "near-buckets")
    central = filed.groupBy("node").agg(F.sum("held").alias("central"))
    leads = filed.join(central, "node").groupBy("bucket").agg(F.max(F.struct(
        "central", (-F.col("node")).alias("minus"), "n")).alias("lead"))
    alike = F.least("n", "n_lead") >= F.lit(threshold) * F.greatest("n", "n_lead")
    stars = filed.join(leads.select("bucket", (-F.col("lead.minus")).alias("lead"),
                                    F.col("lead.n").alias("n_lead")), "bucket")
    # Members of unlike sizes have no link with the lead, but may have with one another.
    stars = cut(stars.filter("node != lead").select(
        F.col("lead").alias("a"), F.col("node").alias("b"), "n", alike.alias("alike"))
        .distinct(), "near-stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.join(nodes.select("node", "key"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("node"),
                        F.col(text_col).cast("binary").alias("text")).join(wanted, "node")
    # Rows that share an id may come more than once; any one that has the key will do.
    units = cut(texts.mapInArrow(_listed, "node long, units binary").groupBy("node").agg(
        F.first("units").alias("units")), "near-units")
    found = _compared(stars.filter("alike").select("a", "b"), units)
    links = cut(found.filter(F.col("like") >= threshold).select("a", "b"), "near-found")
    roots = components(links)
    more = cut(_rest(stars, roots, units, threshold), "near-rest")
    if not more.isEmpty():
        more = _compared(more, units).filter(F.col("like") >= threshold).select("a", "b")
        links = cut(links.union(more).distinct(), "near-found")
        roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"))
    told = nodes.select("key", "node").join(roots, "node", "left").join(degree, "node", "left")
    told = told.select("key", F.coalesce("root", "node").alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("id", "key").join(told, "key").select(
        F.col("id").alias(id_col), "class_id", "n_links")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, and those without an id."""
    told = classes(docs, id_col, text_col, threshold)
    gone = cut(told.filter(F.col(id_col) != F.col("class_id")).select(
        F.col(id_col).alias("near_gone")).distinct(), "near-gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("near_gone"), "left_anti").select("row.*")
