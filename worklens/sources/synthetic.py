"""Works with planted anomalies, for measuring what scoring finds.

Every value is drawn from a hash of the row's id, so the same ids give the same works
whatever the partitioning. The ids come from the caller: a range, or the keys of a table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["North", "South", "East", "West", "Centre"]
CATEGORIES = [
    ("Drinking Water", 800_000, "hand pump and pipeline"),
    ("Road Construction", 1_500_000, "concrete road"),
    ("School Infrastructure", 600_000, "school classroom"),
    ("Community Hall", 900_000, "community hall"),
    ("Street Lighting", 300_000, "solar street light"),
    ("Health Facility", 1_200_000, "health centre ward"),
]
FIRST_DAY = dt.date(2022, 1, 1)


def _draw(key: Column, salt: str, seed: int) -> Column:
    """Uniform in [0, 1): 13 hex digits of an MD5."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _pick(draw: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.floor(draw * len(values)) + 1).cast("int"))


def _between(draw: Column, low: int, high: int) -> Column:
    return (F.floor(draw * (high - low + 1)) + low).cast("int")


def synthetic_works(ids: DataFrame, key: str = "id", seed: int = 42, cost: float = 0.03,
                    delay: float = 0.05, agency: float = 0.04,
                    duplicate: float = 0.0034) -> DataFrame:
    """One work per id with a ``planted`` label; a planted duplicate adds its second phase."""
    u = lambda salt: _draw(F.col(key), salt, seed)
    fate = u("fate")
    edges = [cost, cost + delay, cost + delay + agency, cost + delay + agency + duplicate]
    planted = (
        F.when(fate < edges[0], "cost").when(fate < edges[1], "delay")
        .when(fate < edges[2], "agency").when(fate < edges[3], "duplicate").otherwise("none"))
    place = F.concat(F.lit("Ward "), _between(u("place"), 1, 400).cast("string"))
    kind = (F.floor(u("category") * len(CATEGORIES)) + 1).cast("int")
    at = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CATEGORIES]), kind)
    base = at(1).cast("double")
    rows = ids.select(
        F.col(key), planted.alias("planted"), at(0).alias("category"), at(2).alias("scope"),
        base.alias("base"), place.alias("place"), _pick(u("state"), STATES).alias("state"),
        _between(u("district"), 1, 3).alias("zone"),
        F.concat(F.lit("Agency "), _pick(u("agency"), list("ABCDEFGH"))).alias("usual_agency"),
        F.when(planted == "cost", base * (2.2 + u("amount") * 0.8))
        .otherwise(base * (0.85 + u("amount") * 0.3)).alias("amount"),
        F.date_add(F.lit(FIRST_DAY), _between(u("start"), 0, 700)).alias("start_date"),
        _between(u("length"), 90, 365).alias("length"),
        F.when(planted == "delay", _between(u("late"), 120, 400))
        .when(planted == "agency", _between(u("late"), 150, 300))
        .otherwise(_between(u("late"), -10, 30)).alias("late"),
        u("spent").alias("spent"),
    )
    money = lambda c: F.round(c.cast("decimal(24,8)"), 2).cast("decimal(14,2)")
    works = rows.select(
        F.col(key),
        F.concat(F.lit("Construction of "), F.col("scope"), F.lit(" at "), F.col("place"),
                 F.lit(" "), F.col("state")).alias("description"),
        "state", F.concat_ws(" ", "state", "zone").alias("district"), "category",
        F.when(F.col("planted") == "agency", "Agency X").otherwise(F.col("usual_agency"))
        .alias("implementing_agency"),
        money(F.col("amount")).alias("sanctioned_amount"),
        money(F.col("amount") * (0.7 + F.col("spent") * 0.3)).alias("expenditure"),
        F.lit("completed").alias("work_status"), "start_date",
        F.date_add("start_date", F.col("length")).alias("expected_completion"),
        F.date_add("start_date", F.col("length") + F.col("late")).alias("actual_completion"),
        F.lit("synthetic").alias("source"), "planted",
    )
    second = F.when(F.col("planted") == "duplicate", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1)))
    phase = F.when(F.col("phase") == 2, ", phase 2 continuation").otherwise("")
    return works.withColumn("phase", F.explode(second)).select(
        F.concat_ws("|", F.col(key).cast("string"), "phase", "implementing_agency")
        .alias("work_key"),
        F.concat("description", phase).alias("description"),
        *[c for c in works.columns if c not in (key, "description")])
