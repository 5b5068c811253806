"""Exact percentiles per group that no single task has to hold.

``percentile()`` keeps every distinct value of a group in one task's memory, and a window
sorts the whole group there. Here the group is first reduced to value counts, the counts to
a bounded number of coarse buckets, and only the buckets holding a wanted rank are looked
into, split further while they hold many values - so a group holding a third of all rows costs
each task a bounded range of values, not the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..session import cut

#: Different values that one task may rank, and into how many parts a larger range is split.
MOST_VALUES = 50_000
SPLIT = 1_000


def _bucket(value: Column) -> Column:
    """A coarse key that never decreases as the value grows: decade and three digits."""
    size = F.abs(value)
    decade = F.floor(F.log10(size))
    digits = F.floor(size / F.pow(F.lit(10.0), (decade - 2).cast("double")))
    rank = (decade * 1000 + digits).cast("bigint")
    return (
        F.when(value > 0, rank)
        .when(value == 0, F.lit(-1_000_000_000).cast("bigint"))
        .otherwise(F.lit(-2_000_000_000).cast("bigint") - rank)
    )


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], count_as: str = "n",
    rows_as: str | None = None, most: int = MOST_VALUES,
) -> DataFrame:
    """One row per group: ``count_as`` non-null values, one interpolated column per prob, and
    with ``rows_as`` the rows of the group, null values included.

    The input is read once, for its value counts. A range of values that holds a wanted rank is
    split into SPLIT equal ones, and only those that hold a wanted rank are kept, until no range
    has more than ``most`` different values: measures that crowd take more rounds, not a task
    with all of them.
    """
    keys = list(by) or ["__all"]
    base = df if by else df.withColumn("__all", F.lit(0))
    every = cut(base.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")), "value-counts")
    counts = every.filter(F.col("__v").isNotNull())

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__total") - 1)

    wanted = F.lit(False)
    for p in probs.values():
        for rank in (F.floor(position(p)) + 1, F.ceil(position(p)) + 1):
            wanted = wanted | ((rank > F.col("__from")) & (rank <= F.col("__to")))

    def ranges(rows: DataFrame, part: list[str]) -> DataFrame:
        """Of the buckets ``__b`` within each ``part``, those that hold a wanted rank."""
        along = Window.partitionBy(*part).orderBy("__b")
        found = rows.groupBy(*part, "__b").agg(
            F.sum("__n").alias("__bn"), F.count(F.lit(1)).alias("__d"), F.min("__v").alias("__low"),
            F.max("__v").alias("__high"), F.max("__before").alias("__before"),
            F.max("__whole").alias("__whole"))
        found = found.withColumn("__to", F.col("__before") + F.sum("__bn").over(along)).withColumn(
            "__total", F.coalesce("__whole", F.sum("__bn").over(Window.partitionBy(*part))))
        found = found.withColumn("__from", F.col("__to") - F.col("__bn"))
        return found.filter(wanted).select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__low", "__high", "__from",
            "__total", "__d")

    def inside(chosen: DataFrame) -> DataFrame:
        on = counts["__v"].between(chosen["__low"], chosen["__high"])
        for i, k in enumerate(keys):
            on = on & counts[k].eqNullSafe(chosen[f"__k{i}"])
        return counts.join(chosen, on)

    first = counts.select("*", _bucket(F.col("__v")).alias("__b"), F.lit(0).alias("__before"),
                          F.lit(None).cast("bigint").alias("__whole"))
    chosen = cut(ranges(first, keys), "ranges")
    crowded = (F.col("__d") > most) & (F.col("__low") < F.col("__high"))
    while not chosen.filter(crowded).isEmpty():
        width = (F.col("__high") - F.col("__low")) / SPLIT
        finer = inside(chosen.filter(crowded)).select(
            *keys, "__v", "__n", F.col("__low").alias("__of"), F.col("__from").alias("__before"),
            F.col("__total").alias("__whole"),
            F.least(F.floor((F.col("__v") - F.col("__low")) / width), F.lit(SPLIT - 1)).alias("__b"))
        chosen = cut(chosen.filter(~crowded).unionByName(ranges(finer, [*keys, "__of"])), "ranges")

    ranked = inside(chosen).withColumn("__rank", F.col("__from") + F.sum("__n").over(
        Window.partitionBy(*keys, "__low").orderBy("__v")))
    aggs = [F.max("__total").alias(count_as)]
    for name, p in probs.items():
        low, high = F.floor(position(p)) + 1, F.ceil(position(p)) + 1
        v_low = F.min(F.when(F.col("__rank") >= low, F.col("__v")))
        v_high = F.min(F.when(F.col("__rank") >= high, F.col("__v")))
        weight = F.max(position(p) - F.floor(position(p)))
        aggs.append((v_low + weight * (v_high - v_low)).alias(name))
    result = ranked.groupBy(*keys).agg(*aggs)
    if rows_as is not None:
        sizes = every.groupBy(*keys).agg(F.sum("__n").alias(rows_as))
        on = F.lit(True)
        for k in keys:
            on = on & sizes[k].eqNullSafe(result[k])
        result = sizes.join(result, on, "left").select(
            *[sizes[k] for k in keys], rows_as, count_as, *probs)
    return result if by else result.drop("__all")


def calibrate(df: DataFrame, value: str, probs=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentile report of one measure: where its cut-offs should sit on this population."""
    names = {f"p{round(p * 100):02d}": p for p in probs}
    report = exact_percentiles(df, [], value, names)
    return report.select("n", *[rounded(name, 4).alias(name) for name in names])
