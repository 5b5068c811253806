"""Two registries made from the customers: the members, spelled another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import members

SYLLABLES = ["ba", "ke", "di", "lo", "mu", "ra", "se", "ti", "vo", "na"]


def _spelled(number: Column, at: int) -> Column:
    """Three digits of a scrambled customer number as three syllables."""
    digits = F.lpad(F.pmod(number * 7919, F.lit(1_000_000)).cast("string"), 6, "0")
    parts = [F.element_at(F.array(*[F.lit(s) for s in SYLLABLES]),
                          F.substring(digits, at + i, 1).cast("int") + 1) for i in range(3)]
    return F.concat(*parts)


def our_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with pronounceable names; every sixtieth is missing from our record."""
    number = F.col("mp_id").cast("bigint")
    full = F.concat(F.lit("Shri "), F.initcap(_spelled(number, 1)), F.lit(" "),
                    F.initcap(_spelled(number, 4)))
    dressed = F.when(F.col("house") == "Rajya Sabha", F.concat(full, F.lit(" (2020-26)"))) \
        .otherwise(F.concat(full, F.lit(" (17th Lok Sabha)")))
    return members(spark, sf_dir).filter(number % 60 != 11).select(
        "mp_id", "ls_term", dressed.alias("mp_name"), "constituency", "state", "house",
        "allocated_amount", "amount_recommended", "total_expenditure")


def _registry(spark: SparkSession, sf_dir: str, house: str) -> DataFrame:
    number = F.col("mp_id").cast("bigint")
    last = F.initcap(_spelled(number, 4))
    # Every tenth surname is written with another vowel.
    last = F.when(number % 10 == 3, F.regexp_replace(last, "[ou]", "a")).otherwise(last)
    return members(spark, sf_dir).filter((F.col("house") == house) & (number % 40 != 9)).select(
        (number + 10_000).alias("reg_id"), number.alias("number"), "ls_term", "state",
        "constituency", F.initcap(_spelled(number, 1)).alias("first_name"),
        last.alias("last_name"),
        F.concat(F.lit("Party "), (number % 7).cast("string")).alias("party"),
        F.concat(F.lit("P"), (number % 7).cast("string")).alias("party_short"),
        F.when(number % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (F.lit(30) + number % 50).cast("int").alias("age"),
        F.lit("12345").alias("phone"), F.lit(" Farmer ").alias("profession"),
        F.when(number % 3 == 0, "Teacher").alias("profession2"),
        F.lit("Graduate").alias("qualification"),
        F.when(number % 4 == 0, "Former").otherwise("Sitting").alias("status"))


def lower_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surname first; every fiftieth member is listed at another seat in another state."""
    moved = F.col("number") % 50 == 7
    return _registry(spark, sf_dir, "Lok Sabha").select(
        "*", F.concat_ws(" ", "last_name", "first_name").alias("name"),
        F.when(moved, F.lit("Elsewhere")).otherwise(F.col("constituency")).alias("seat"),
    ).withColumn("state", F.when(moved, F.lit("NOWHERE")).otherwise(F.col("state"))) \
        .drop("constituency", "number")


def upper_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per member; nominated members are filed under "Nominated", not a state."""
    return _registry(spark, sf_dir, "Rajya Sabha").withColumn(
        "state", F.when(F.lower("constituency").contains("nominated"), "Nominated")
        .otherwise(F.col("state"))).withColumn(
        "name", F.concat_ws(" ", "first_name", "last_name")).withColumn(
        "term", F.when(F.col("number") % 2 == 0, "2020-2026").otherwise("2018-24")) \
        .dropDuplicates(["reg_id"]).drop("constituency", "number", "ls_term")
