"""Our totals beside the official ones and an aggregator's, and which hop a gap lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, rounded, sum_where, total

CRORE = 1e7


def our_totals(works: DataFrame, members: DataFrame, ls_term: int) -> DataFrame:
    """Five totals of one term in long form; works recommended counts the whole pipeline."""
    done = F.col("work_status") == "completed"
    held = works.filter(F.col("ls_term") == ls_term).agg(
        count_where(done | (F.col("work_status") == "recommended")).cast("double").alias("pipeline"),
        count_where(done).cast("double").alias("completed"),
        (sum_where(done, "expenditure") / CRORE).alias("value"))
    money = members.filter(F.col("ls_term") == ls_term).agg(
        (total("allocated_amount") / CRORE).alias("allocated"),
        (total("total_expenditure") / CRORE).alias("expenditure"))
    metrics = [("Allocated", "allocated", "crore"), ("Expenditure", "expenditure", "crore"),
               ("Works in pipeline", "pipeline", "count"), ("Works completed", "completed", "count"),
               ("Completed value", "value", "crore")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(c).alias("value"), F.lit(unit).alias("unit"))
        for metric, c, unit in metrics]))
    return held.join(F.broadcast(money)).select(rows.alias("r")).select("r.*")


def reconcile(ours: DataFrame, official: DataFrame, aggregator: DataFrame) -> DataFrame:
    """Full outer on metric; a gap is NULL where the figure to compare with is absent or 0."""
    side = lambda df, name: df.select("metric", F.col("value").alias(name))
    rows = (
        side(ours, "ours").join(side(official, "official"), "metric", "full")
        .join(side(aggregator, "aggregator"), "metric", "full")
        .join(ours.select("metric", "unit"), "metric", "left")
    )
    gap = lambda a, b: F.when(F.col(b) != 0, (F.col(a) - F.col(b)) / F.col(b) * 100)
    hop = F.when(F.col("aggregator") != 0, gap("aggregator", "official"))
    return rows.select(
        "metric", rounded("ours", 2).alias("ours"), rounded("official", 2).alias("official"),
        "unit", rounded(gap("ours", "official"), 2).alias("gap_pct"),
        rounded("aggregator", 2).alias("aggregator"),
        rounded(hop, 2).alias("aggregator_gap_pct"))


def worst_hops(reconciled: DataFrame) -> DataFrame:
    """The whole chain's worst gap, and the worst of each of its two hops."""
    ours = F.when(F.col("aggregator") != 0,
                  F.abs(F.col("ours") - F.col("aggregator")) / F.col("aggregator") * 100)
    return reconciled.agg(
        F.max(F.abs("gap_pct")).alias("worst_gap_pct"),
        rounded(F.max(ours), 4).alias("worst_our_hop_pct"),
        F.max(F.abs("aggregator_gap_pct")).alias("worst_upstream_hop_pct"))
