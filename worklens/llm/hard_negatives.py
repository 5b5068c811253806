"""Hard negatives by exact integer products, several candidates in one wide integer.

Components become whole numbers, floor(scale * x). Biased by the smallest of the table they are
not negative, and the components of FIELDS candidates stand side by side in one wide integer,
each in a field wide enough for the largest sum of products that the table allows. One multiply
with an anchor's component then serves all of its candidates; the sums over the components are
taken apart field by field, and what the bias added is taken off again. The wide integers stay
below 2**52 and are held as float64, which is exact there, so that the products run in BLAS.
Anchors too large for that are split into limbs of fewer bits.

Candidates are packed into blocks where they are read, anchors likewise. A grid of cells deals
them: each cell holds at most SIDE anchors and about SIDE candidates, and every anchor block
meets every candidate block of its cell. A task keeps, of each anchor, only the first few rows;
those of all cells are ranked by Spark. The first pass finds the positives (blocks without a
label in common never meet), the second the negatives inside each positive's range.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component
take no part; a shorter vector counts as padded with zeros; equal scores go by the smaller id;
rows with the anchor's id are never its partners. Rows that share an id are rows of their own,
but equal ones (id, label and vector as an anchor; id and score as a partner) count once. An
empty table, or one without anchors, gives an empty result; further columns are passed over.
Components so large that a score may not fit a long are refused.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .tables import bounded

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's must and may reach.
LEAST, MOST = 50, 95
#: Rows of one block of anchors, of candidates, and of one side of a cell.
ANCHORS, CANDIDATES, SIDE = 512, 2048, 65_536
#: Bits that a float64 holds exactly, one spared.
BITS = 52
LOWEST = np.iinfo(np.int64).min
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Packing:
    """How components are packed; the same for all rows of a table."""
    dims: int
    low: int       # smallest component: the bias
    width: int     # bits of a field
    fields: int    # candidates in one integer
    limb: int      # bits of a part of an anchor's component
    limbs: int

    @classmethod
    def of(cls, dims: int, low: int, high: int) -> "Packing":
        span = max(1, high - low)
        most = (dims * span).bit_length()
        if dims * max(abs(low), abs(high)) ** 2 >= 1 << 63 or most >= BITS:
            raise ValueError(f"{dims} components from {low} to {high} are too large: a score "
                             "may not fit a long")
        limb = min(span.bit_length(), BITS - most)
        width = (dims * span * ((1 << limb) - 1)).bit_length()
        return cls(dims, low, width, max(1, BITS // width), limb,
                   -(-span.bit_length() // limb))

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """(dims, groups) wide integers of rows of components; empty fields hold zeros."""
        groups = -(-len(rows) // self.fields)
        wide = np.zeros((self.dims, groups), np.int64)
        for k in range(self.fields):
            part = rows[k::self.fields] - self.low
            wide[:, :len(part)] += part.T << (self.width * k)
        return wide.astype(np.float64)

    def products(self, anchors: np.ndarray, wide: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Exact scores of every anchor with every packed candidate; ``sums`` are those of the
        candidates' components."""
        biased = anchors - self.low
        n = len(sums)
        total = np.zeros((len(anchors), n), np.int64)
        mask = (1 << self.width) - 1
        for part in range(self.limbs):
            digit = (biased >> (self.limb * part)) & ((1 << self.limb) - 1)
            found = (digit.astype(np.float64) @ wide).astype(np.int64)
            for k in range(self.fields):
                own = total[:, k::self.fields]
                own += ((found >> (self.width * k)) & mask)[:, :own.shape[1]] << (self.limb * part)
        # (a + b)(c + b) summed, less what the bias b = -low brought in.
        own = anchors.sum(axis=1, dtype=np.int64)
        total += self.low * (own[:, None] + sums[None, :]) - self.dims * self.low * self.low
        return total


class Best:
    """The first ``most`` partners of each anchor, by score, then by the smaller id, among
    those whose score lies from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most
        self.score = np.full((len(low), most), LOWEST)
        self.id = np.full((len(low), most), NOBODY)

    def offer(self, scores: np.ndarray, fit: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` are those of the columns of ``scores``; ``fit`` masks who may be a partner."""
        least = np.maximum(self.low, self.score[:, -1])
        # With an equal score only a smaller id comes before the last one held.
        least = least + ((ids.min() > self.id[:, -1]) & (self.score[:, -1] >= self.low))
        fit = fit & (scores >= least[:, None]) & (scores <= self.high[:, None])
        many = fit.sum(axis=1)
        full = np.flatnonzero(many > 4 * self.most)
        # Ids that come twice would fill places that belong to others.
        if len(full) and len(np.unique(ids)) == len(ids):
            some = np.where(fit[full], scores[full], LOWEST)
            at = some.shape[1] - self.most
            fit[full] &= some >= np.partition(some, at, axis=1)[:, at][:, None]
        row, col = np.nonzero(fit)
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([row, np.repeat(touched, self.most)])
        score = np.concatenate([scores[fit], self.score[touched].ravel()])
        who = np.concatenate([ids[col], self.id[touched].ravel()])
        order = np.lexsort((who, -1 - score, row))
        row, score, who = row[order], score[order], who[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (who[1:] != who[:-1])
        row, score, who = row[new], score[new], who[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.most
        self.score[touched], self.id[touched] = LOWEST, NOBODY
        self.score[row[kept], place[kept]] = score[kept]
        self.id[row[kept], place[kept]] = who[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, partner's id and score of all partners held."""
        row, at = np.nonzero(self.id != NOBODY)
        return row, self.id[row, at], self.score[row, at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of components, padded with zeros."""
    many = np.array(column.value_lengths(), np.int64)
    flat = np.array(column.flatten(), np.int64)
    if (many == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(many), dims), np.int64)
    out[np.arange(dims) < many[:, None]] = flat
    return out


def _blocks(size: int, p: Packing, packed: bool):
    """Blocks of rows ordered by label and id. The order is taken over one batch of rows."""
    names = ["low", "high", "row", "id", "label", "sum", "vectors", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("label", "ascending"), ("id", "ascending")])
            for begin in range(0, table.num_rows, size):
                part = table.slice(begin, size).combine_chunks()
                rows = _matrix(part["vector"].combine_chunks(), p.dims)
                label = np.array(part["label"], np.int64)
                told = [np.array(part[c], np.int64).tobytes() for c in ("row", "id", "label")]
                vectors = p.pack(rows) if packed else rows.astype(np.int32)
                others = [part["others"].to_pylist()] if "others" in part.column_names else [None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(label[0])]), pa.array([int(label[-1])])]
                    + [pa.array([b], pa.binary()) for b in (
                        *told, rows.sum(axis=1, dtype=np.int64).tobytes(), vectors.tobytes())]
                    + [pa.array(others, pa.list_(pa.list_(pa.int64())))], names)
    return run


_BLOCK = ("low long, high long, row binary, id binary, label binary, sum binary, vectors binary, "
          "others array<array<long>>")


def _whole(value: pa.Scalar, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def _met(p: Packing, positives: int, negatives: int, least: int, most: int, same: bool):
    """Of each anchor of a cell its first partners: of the same label, or of other labels
    within the range of each of its positives' scores (numbered by ``slot``)."""
    def finish(state) -> pa.RecordBatch:
        row, anchor, found = state
        columns = [np.zeros(0, np.int64)] * 5
        for slot, best in enumerate(found):
            at, who, score = best.rows()
            part = [row[at], anchor[at], np.full(len(at), slot), who, score]
            columns = [np.concatenate(pair) for pair in zip(columns, part)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns],
                                          ["row", "anchor_id", "slot", "other", "score"])

    def begin(batch: pa.RecordBatch, k: int):
        row, anchor = (_whole(batch.column(c)[k]) for c in ("row", "id"))
        n = len(anchor)
        if same:
            return row, anchor, [Best(np.full(n, LOWEST + 1), np.full(n, NOBODY), positives)]
        scores = np.full((n, positives), 0)
        known = np.zeros((n, positives), bool)
        for i, told in enumerate(batch.column("others")[k].as_py()):
            scores[i, :len(told)], known[i, :len(told)] = told, True
        # 50 * positive <= 100 * negative <= 95 * positive, in whole numbers.
        low, high = -((-least * scores) // 100), (most * scores) // 100
        return row, anchor, [Best(np.where(known, low, NOBODY)[:, s], np.where(
            known, high, LOWEST)[:, s], negatives) for s in range(positives)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: OrderedDict = OrderedDict()
        for batch in batches:
            for k in range(batch.num_rows):
                name = (batch.column("cell")[k].as_py(), batch.column("block")[k].as_py())
                if name not in states:
                    # The blocks of one anchor block come together: a few states are enough.
                    while len(states) >= 4:
                        yield finish(states.popitem(last=False)[1])
                    states[name] = begin(batch, k)
                _, anchor, found = states[name]
                ids, sums = (_whole(batch.column(c)[k]) for c in ("c_id", "c_sum"))
                wide = _whole(batch.column("c_vectors")[k], np.float64).reshape(p.dims, -1)
                own = _whole(batch.column("vectors")[k], np.int32).reshape(-1, p.dims)
                scores = p.products(own.astype(np.int64), wide, sums)
                labels, theirs = (_whole(batch.column(c)[k]) for c in ("label", "c_label"))
                fit = (labels[:, None] == theirs) if same else (labels[:, None] != theirs)
                if same:
                    fit &= anchor[:, None] != ids
                for best in found:
                    best.offer(scores, fit, ids)
        for state in states.values():
            yield finish(state)
    return run


def _meet(anchors: DataFrame, blocks: DataFrame, sides: tuple[int, int]) -> DataFrame:
    """Every anchor block with every candidate block of each cell of the grid."""
    rows, columns = sides
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = anchors.withColumn("g", spread(columns)).withColumn(
        "cell", F.col("g") * F.lit(rows) + F.pmod("block", F.lit(rows))).drop("g")
    theirs = blocks.withColumn("g", spread(rows)).withColumn(
        "cell", F.pmod("block", F.lit(columns)) * F.lit(rows) + F.col("g"))
    return ours.hint("merge").join(theirs.select("cell", *[F.col(c).alias(f"c_{c}") for c in (
        "low", "high", "id", "label", "sum", "vectors")]), "cell")


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding", scale: float = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                   most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every
    row that ``anchor`` holds for and each of its ``positives`` first rows of the same label,
    the ``negatives`` first rows of other labels whose score lies from ``least`` to ``most``
    percent of the positive's."""
    spark = rows.sparkSession
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = rows.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(label_col)
    vector = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    used = bounded(rows).filter(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
        & ~F.exists(vector_col, odd)).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    told = used.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"),
        F.max(F.size("vector")).alias("dims"), F.min(F.array_min("vector")).alias("low"),
        F.max(F.array_max("vector")).alias("high")).first()
    result = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    if not told["anchors"]:
        return spark.createDataFrame([], result)
    p = Packing.of(max(1, told["dims"]), min(0, told["low"] or 0), max(0, told["high"] or 0))
    # Sides of the grid: bounded cells; of a small table, enough of them to share the work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(-(-told["n"] // SIDE), min(tasks, -(-told["n"] // CANDIDATES)))
    sides = (-(-told["anchors"] // SIDE), columns)

    def packed(df: DataFrame, size: int, wide: bool) -> DataFrame:
        # Small partitions are read together, so that blocks are full.
        few = df.coalesce(-(-(told["n"] if wide else told["anchors"]) // size))
        return few.mapInArrow(_blocks(size, p, wide), _BLOCK).withColumn(
            "block", F.xxhash64("id", "vectors"))

    row = F.xxhash64("id", "label", "vector").alias("row")
    blocks = cut(packed(used.select("id", "label", "vector", F.lit(0).cast("long").alias("row")),
                        CANDIDATES, True).drop("row", "others"), "negatives-blocks")
    ours = cut(used.filter("anchor").select(row, "id", "label", "vector").dropDuplicates(["row"]),
               "negatives-anchors")
    schema = "row long, anchor_id long, slot long, other long, score long"
    ordered = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy(
        F.desc("score"), "other"))

    def partners(anchors: DataFrame, same: bool) -> DataFrame:
        met = _meet(packed(anchors, ANCHORS, False), blocks, sides)
        if same:
            met = met.filter((F.col("low") <= F.col("c_high")) & (F.col("c_low") <= F.col("high")))
        return met.select("cell", "block", "row", "id", "label", "vectors", "others", "c_id",
                          "c_label", "c_sum", "c_vectors").mapInArrow(
            _met(p, positives, negatives, least, most, same), schema)

    near = partners(ours, True).withColumn("place", ordered("row")).filter(
        F.col("place") <= positives).distinct()
    near = cut(near.select("row", "anchor_id", "place", F.col("other").alias("positive_id"),
                           F.col("score").alias("positive_score")), "negatives-positives")
    listed = near.groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))),
        lambda x: x["positive_score"]).alias("others"))
    found = partners(ours.join(listed, "row"), False).withColumn(
        "rank", ordered("row", "slot")).filter(F.col("rank") <= negatives).distinct()
    return found.select("row", (F.col("slot") + 1).alias("place"), "rank",
                        F.col("other").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(near, ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")
