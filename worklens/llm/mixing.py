"""Mixing sources to target weights by hash thresholds, without a sort.

Each row has a place on a line of 60 bits, given by a hash of its id and text. A source takes
every row a whole number of times and, to come near its target, once more each row whose place
lies under the source's threshold. The threshold is found by histograms: sizes are summed by
source and bucket of the leading bits, the bucket in which the budget runs out is opened and
summed by the next bits, and so on until it holds one place. Rows are then filtered by one
comparison. A larger budget only raises the threshold, so mixes are nested.

Defined results: a null text has size 0; a null source is a source of its own, after all
others; rows without words follow their place like any other and add nothing; a source without
words, like an empty table, takes nothing. Rows equal in id and text share a place, so they are
taken alike. The nearest total wins; on a tie the smaller one. ``mix`` carries further columns
through, whatever their names.

The source totals (one row a source) are ranked and levelled in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def place(id_col: Column, text: Column) -> Column:
    """60 bits from a hash that any engine has, of the id and the text."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"),
                   F.coalesce(F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(mix_source, mix_total) with the mix_target of each source.

    A target stops at ``most`` times the total and the excess goes to the others by weight.
    That levels off where target = min(most * total, level * weight): with the sources in order
    of total / weight, the level is what is left after the first k are full, over the weight of
    the rest, for the smallest k that leaves none of the rest above its stop; any larger k
    that does so leaves a lower level.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn(
        "stop", F.lit(float(most)) * F.col("mix_total"))
    ranked = ranked.withColumn("ratio", F.col("stop") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("mix_total").over(every) * F.lit(float(share))
             - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("here", level)
    ranked = ranked.withColumn("level", F.max(
        F.when(F.col("here") <= F.col("ratio"), F.col("here"))).over(every))
    return ranked.select("mix_source", "mix_total", F.least(
        F.col("stop"), F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight"))
        .alias("mix_target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE,
               most: int = MOST) -> DataFrame:
    """(mix_source, mix_total, mix_target, mix_base, mix_under) from (source, place, size).

    A row is taken mix_base times, and once more if its place is under mix_under. ``rows``
    should be stored: it is read once for the totals and once for each level of buckets.
    """
    rows = rows.select("source", "place", "size")
    totals = rows.groupBy(F.col("source").alias("mix_source")).agg(
        F.sum("size").alias("mix_total"))
    goal = cut(targets(totals, weights, share, most), "mix-targets").withColumn(
        "mix_base", F.coalesce(F.floor(F.try_divide("mix_target", "mix_total")),
                               F.lit(0)).cast("long"))
    rest = F.col("mix_target") - F.col("mix_base") * F.col("mix_total")
    edge = goal.filter("mix_total > 0").select(
        "mix_source", F.lit(0).cast("long").alias("low"), rest.alias("rest"))
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        held = rows.join(edge, same("source", "mix_source")
                         & (F.shiftright("place", shift + STEP) == F.col("low")))
        held = held.groupBy("mix_source", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("held"), F.first("rest").alias("rest"),
            F.min("place").alias("least"), F.max("place").alias("largest"))
        order = Window.partitionBy("mix_source").orderBy("bucket")
        before = F.coalesce(F.sum("held").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # What is left is less than the sum of all buckets, so it runs out in just one.
        edge = held.withColumn("before", before).filter(
            (F.col("before") <= F.col("rest"))
            & (F.col("before") + F.col("held") > F.col("rest")))
        edge = cut(edge.select("mix_source", F.col("bucket").alias("low"), "held", "least",
                               (F.col("rest") - F.col("before")).alias("rest"),
                               (F.col("least") == F.col("largest")).alias("lone")), "mix-edge")
        # A lone place is taken if that comes nearer than leaving it.
        nearer = F.col("held") - F.col("rest") < F.col("rest")
        ends = edge.filter("lone").select(F.col("mix_source").alias("s"), (
            F.col("least") + nearer.cast("long")).alias("mix_under"))
        found = ends if found is None else found.union(ends)
        edge = edge.filter("not lone").select("mix_source", "low", "rest")
        if edge.isEmpty():
            break
    return goal.join(found, same("mix_source", "s"), "left").select(
        "mix_source", "mix_total", "mix_target", "mix_base",
        F.coalesce("mix_under", F.lit(0)).alias("mix_under"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(id, source, place, size) of every row: all that the thresholds need."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       place(F.col(id_col), F.col(text_col)).alias("place"),
                       n_words(F.col(text_col)).alias("size"))


def copies(base: str = "mix_base", under: str = "mix_under", at: str = "place") -> Column:
    return F.col(base) + F.when(F.col(at) < F.col(under), 1).otherwise(0)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
               most: int = MOST) -> DataFrame:
    """One row a document: its size, its source's size and target, and the words taken."""
    rows = cut(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = thresholds(rows, weights, share, most)
    return rows.join(plan, same("source", "mix_source")).select(
        F.col("id").alias(id_col), "size", F.col("mix_total").alias("source_size"),
        F.col("mix_target").alias("target"), (copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
        most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns."""
    rows = cut(sized(docs, id_col, text_col, source_col).drop("id"), "mix-sizes")
    plan = thresholds(rows, weights, share, most).select("mix_source", "mix_base", "mix_under")
    placed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"),
                         place(F.col(id_col), F.col(text_col)).alias("place"))
    times = copies().cast("int")
    taken = placed.join(plan, same("source", "mix_source")).filter(times > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
