"""Peer baselines: median cost per group, an agency's delay rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..session import cut
from .quantiles import exact_percentiles

PEER_KEYS = ["district", "sector"]


def peer_stats(works: DataFrame, keys=PEER_KEYS, amount: str = "sanctioned_amount") -> DataFrame:
    """Exact median and size of each peer group; groups with a NULL key are no groups."""
    present = works
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    stats = exact_percentiles(present, list(keys), amount, {"__median": 0.5}, "__priced",
                              rows_as="peer_count")
    return stats.select(*keys, "peer_count", rounded("__median", 2).alias("peer_median_cost"))


def peer_baseline(
    works: DataFrame, keys=PEER_KEYS, amount: str = "sanctioned_amount", min_peers: int = 8,
) -> DataFrame:
    """Adds ``peer_median_cost``, ``peer_count`` and ``cost_deviation_pct``.

    The deviation uses the already rounded median; thin groups deviate 0 by definition. The
    statistics are cut first: their written size tells the planner whether they may be
    broadcast, and then the works are joined without being shuffled.
    """
    joined = works.join(cut(peer_stats(works, keys, amount), "peers"), list(keys), "left")
    median = F.col("peer_median_cost")
    deviation = rounded(
        F.try_divide(F.col(amount).cast("double") - median, median) * 100, 2)
    return joined.withColumn(
        "cost_deviation_pct",
        F.when(F.col("peer_count") < min_peers, F.lit(0.0)).otherwise(deviation),
    )


def agency_delay_rate(
    works: DataFrame, late_days: int = 60, agency: str = "implementing_agency",
) -> DataFrame:
    """Share of an agency's works delayed beyond ``late_days``, pooled over terms."""
    late = F.count(F.when(F.col("delay_days") > late_days, 1))
    return (
        works.filter(F.col(agency).isNotNull()).groupBy(agency)
        .agg(rounded(late / F.count(F.lit(1)) * 100, 2).alias("agency_delay_rate"))
    )


def attach_delay_rate(works: DataFrame, late_days: int = 60) -> DataFrame:
    rates = cut(agency_delay_rate(works, late_days), "delay-rates")
    return works.join(rates, "implementing_agency", "left")
