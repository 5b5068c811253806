"""Vendor concentration and payment ageing per implementing agency and term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.risk import concentration_risk
from ..params import Params

PROFILE_COLUMNS = [
    "implementing_agency", "ls_term", "vendor_count", "transaction_count", "total_spend",
    "vendor_hhi", "top_vendor", "top_vendor_share_pct", "pending_count",
    "oldest_pending_days", "concentration_risk",
]


def hhi(df: DataFrame, group: list[str], part: str, amount: str) -> DataFrame:
    """Sum of squared spend shares per group; 0 when the group spent nothing."""
    spend = (
        df.filter(F.col(part).isNotNull()).groupBy(*group, part)
        .agg(F.sum(amount).cast("double").alias("__s"))
    )
    total = F.sum("__s")
    index = F.when(total > 0, F.try_divide(F.sum(F.col("__s") * F.col("__s")), total * total))
    return spend.groupBy(*group).agg(rounded(F.coalesce(index, F.lit(0.0)), 4).alias("hhi"))


def vendor_profile(payments: DataFrame, p: Params) -> DataFrame:
    """One row per (agency, term).

    Two aggregation levels: payments reduce to (agency, term, vendor) with map-side partials
    first, so an agency paying a third of everything reaches the second level as its vendors.
    """
    if "ls_term" not in payments.columns:
        payments = payments.withColumn("ls_term", F.lit(0))
    pending = ~F.col("payment_status").eqNullSafe(F.lit(p.paid_status))
    per_vendor = (
        payments.filter(F.col("implementing_agency").isNotNull())
        .withColumn("ls_term", F.coalesce(F.col("ls_term").cast("int"), F.lit(0)))
        .groupBy("implementing_agency", "ls_term", "vendor")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("expenditure_amount").alias("paid"),
            F.count(F.when(pending, 1)).alias("pending"),
            F.min(F.when(pending, F.col("expenditure_date"))).alias("oldest"),
        )
        .withColumn("spend", F.when(F.col("vendor").isNotNull(), F.col("paid")))
        .withColumn("dspend", F.col("spend").cast("double"))
    )
    profile = per_vendor.groupBy("implementing_agency", "ls_term").agg(
        F.count("vendor").alias("vendor_count"),
        F.sum("n").alias("transaction_count"),
        F.coalesce(F.sum("spend").cast("double"), F.lit(0.0)).alias("total_spend"),
        F.sum(F.col("dspend") * F.col("dspend")).alias("squares"),
        F.max("dspend").alias("top_spend"),
        # Equal spends: the first vendor by name, so that a rerun names the same one.
        F.min_by("vendor", F.when(F.col("vendor").isNotNull(),
                                  F.struct((-F.col("dspend")).alias("s"), F.col("vendor"))))
        .alias("top_vendor"),
        F.sum("pending").alias("pending_count"),
        F.min("oldest").alias("oldest"),
    )
    spent = F.col("total_spend")
    index = F.when(spent > 0, F.col("squares") / (spent * spent)).otherwise(F.lit(0.0))
    share = F.when(spent > 0, F.col("top_spend") / spent * 100).otherwise(F.lit(0.0))
    return profile.withColumn("index", index).select(
        "implementing_agency", "ls_term", "vendor_count", "transaction_count",
        F.round(F.col("total_spend").cast("decimal(38,8)"), 2).cast("double").alias("total_spend"),
        rounded("index", 4).alias("vendor_hhi"),
        "top_vendor",
        rounded(share, 2).alias("top_vendor_share_pct"),
        "pending_count",
        F.coalesce(F.datediff(F.lit(p.as_of), "oldest"), F.lit(0)).alias("oldest_pending_days"),
        concentration_risk("index", "transaction_count", p).alias("concentration_risk"),
    )


AGENCY_COLUMNS = [
    "concentration_risk", "oldest_pending_days", "pending_count", "top_vendor",
    "top_vendor_share_pct", "total_spend", "vendor_count", "transaction_count",
]


def attach_profile(works: DataFrame, profile: DataFrame | None) -> DataFrame:
    """Left join on (agency, term): an agency without payments keeps its works."""
    types = {"top_vendor": "string", "concentration_risk": "double", "total_spend": "double",
             "top_vendor_share_pct": "double", "oldest_pending_days": "int"}
    if profile is None:
        return works.withColumns({
            f"agency_{c}": F.lit(None).cast(types.get(c, "bigint")) for c in AGENCY_COLUMNS})
    right = profile.select(
        F.col("implementing_agency").alias("__agency"), F.col("ls_term").alias("__term"),
        *[F.col(c).alias(f"agency_{c}") for c in AGENCY_COLUMNS],
    )
    term = F.coalesce(F.col("ls_term").cast("int"), F.lit(0)) if "ls_term" in works.columns \
        else F.lit(0)
    return (
        works.withColumn("__wt", term)
        .join(right, (F.col("implementing_agency") == F.col("__agency"))
              & (F.col("__wt") == F.col("__term")), "left")
        .drop("__agency", "__term", "__wt")
    )
