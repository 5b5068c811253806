"""The driver's star-schema tables viewed as works, payments, members and reviews.

The dimension joins are left to Catalyst and AQE: whether ``part`` or ``supplier`` is
broadcast depends on its measured size, not on a hint.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classify
from ..params import Params

AS_OF = dt.date(2001, 8, 1)
TERM_SPLIT = dt.date(1998, 6, 1)

# Fixture sector rules: the second word of a part's name.
PART_RULES = [
    ("Anvils", ["anvil"]), ("Bolts", ["bolt"]), ("Gears", ["gear"]), ("Gizmos", ["gizmo"]),
    ("Plates", ["plate"]), ("Rings", ["ring"]), ("Rods", ["rod"]), ("Widgets", ["widget"]),
]

# Thresholds under which the uniform driver data still produces findings.
FIXTURE = Params(
    as_of=AS_OF,
    burst_min_payments=10, burst_floor=10.0, burst_ceiling=30.0,
    digit_floor=5.9, digit_ceiling=7.2,
    idle_min_allocation=1e5, idle_min_works=3, idle_floor=20.0, idle_ceiling=45.0,
    uniform_floor=12.5, uniform_ceiling=15.2,
    hhi_floor=0.042, hhi_ceiling=0.050,
    quiet_days=15,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _term(order_date: Column) -> Column:
    return F.when(order_date < F.lit(TERM_SPLIT), F.lit(17)).otherwise(F.lit(18))


def _money(value: Column, digits: int = 2) -> Column:
    return F.round(value.cast("decimal(24,8)"), digits).cast("decimal(14,2)")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("order_date", F.col("o_orderdate").cast("date"))
        .withColumn("ship_date", F.col("l_shipdate").cast("date"))
        .transform(_derived)
    )


def _derived(dated: DataFrame) -> DataFrame:
    return (
        dated.withColumn("ls_term", _term(F.col("order_date")))
        .withColumn("member_name",
                    F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
        .withColumn("paid", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    )


#: Lines that a part holds at most, on average.
PART_LINES = 250_000


def parts_for(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts the lines are dealt: a join would deal fewer than its own anew. The
    number of lines is in the files' footers.
    """
    n = table(spark, sf_dir, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_LINES))


def lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """The joined lines with the columns that works and payments are made of, dealt by order.

    Parts are looked up first, while a line has nothing but its own columns: should they be too
    many to broadcast, only those are moved. Lines and orders then move once, and everything
    that belongs to an order is found in its part.
    """
    t = lambda name: table(spark, sf_dir, name)
    own = (
        t("lineitem").withColumn("ship_date", F.col("l_shipdate").cast("date"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "ship_date", "p_name",
                "p_type", "p_brand")
    )
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                F.col("o_orderdate").cast("date").alias("order_date"))
    return (
        own.repartition(parts, "l_orderkey")
        .join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(*own.columns, "o_custkey", "o_orderpriority", "order_date", "s_name", "n_name",
                "r_name")
    )


def works(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None) -> DataFrame:
    """The lines as works; ``dealt`` are ``lines`` that have been written."""
    completed = F.col("l_linestatus") == "F"
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    description = F.concat_ws(" ", F.col("p_name"), F.lower("p_type"))
    return _lines_of(spark, sf_dir, dealt).select(
        F.concat_ws("|",
                    F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"),
                    "ls_term", "s_name").alias("work_key"),
        F.col("l_orderkey").alias("order_id"),
        description.alias("description"),
        "ls_term",
        F.col("member_name").alias("mp_name"),
        F.col("o_custkey").cast("string").alias("mp_id"),
        _house(F.col("o_custkey")).alias("house"),
        _constituency(F.col("o_custkey")).alias("constituency"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("district"),
        F.col("o_orderpriority").alias("category"),
        F.col("s_name").alias("implementing_agency"),
        price.alias("recommended_amount"),
        price.alias("sanctioned_amount"),
        F.when(completed, _money(F.col("paid") * (1 + F.col("l_tax"))))
        .otherwise(F.lit(0).cast("decimal(14,2)")).alias("expenditure"),
        F.when(completed, "completed").otherwise("recommended").alias("work_status"),
        F.col("order_date").alias("start_date"),
        F.date_add("order_date", 365).alias("expected_completion"),
        F.when(completed & (F.col("l_returnflag") != "R"), F.col("ship_date"))
        .alias("actual_completion"),
        F.lit("fixture").alias("source"),
        F.when(F.col("l_returnflag") == "A", F.lit(True))
        .when(F.col("l_returnflag") == "N", F.lit(False)).alias("has_images"),
        classify(description, PART_RULES, ascii_only=True).alias("sector"),
    )


def _lines_of(spark: SparkSession, sf_dir: str, dealt: DataFrame | None) -> DataFrame:
    return _joined(spark, sf_dir) if dealt is None else _derived(dealt)


def _house(custkey: Column) -> Column:
    return F.when(custkey % 5 == 0, "Rajya Sabha").otherwise("Lok Sabha")


def _constituency(custkey: Column) -> Column:
    upper = F.when(custkey % 10 == 0, "Nominated Rajya Sabha").otherwise("Sitting Rajya Sabha")
    lower = F.concat(F.lit("Seat "), (custkey % 543).cast("string"))
    return F.when(custkey % 5 == 0, upper).otherwise(lower)


def payments(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None) -> DataFrame:
    return _lines_of(spark, sf_dir, dealt).select(
        "ls_term",
        F.col("member_name").alias("mp_name"),
        F.col("o_custkey").cast("string").alias("mp_id"),
        _constituency(F.col("o_custkey")).alias("constituency"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("district"),
        F.lower("p_type").alias("work_type_text"),
        F.col("p_brand").alias("vendor"),
        F.col("s_name").alias("implementing_agency"),
        _money(F.col("paid")).alias("expenditure_amount"),
        F.col("ship_date").alias("expenditure_date"),
        F.when(F.col("l_returnflag") == "R", "Payment In-Progress")
        .otherwise("Payment Success").alias("payment_status"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (member, term): money published by the source, not recomputed later."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").withColumn("ls_term", _term(F.col("o_orderdate").cast("date")))
    recommended = orders.groupBy("o_custkey", "ls_term").agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("amount_recommended"))
    paid = (
        t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "ls_term")
        .agg(
            F.sum(_money(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("total_expenditure"),
            F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("completed_works"),
            F.count(F.lit(1)).alias("recommended_works"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("pending_payments"),
        )
    )
    key = F.col("o_custkey")
    joined = (
        recommended.join(paid, ["o_custkey", "ls_term"])
        .join(t("customer"), key == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    allocated = _money(F.col("amount_recommended") * (1 + (key % 10) / 10.0))
    return joined.select(
        key.cast("string").alias("mp_id"),
        "ls_term",
        F.col("c_name").alias("mp_name"),
        _constituency(key).alias("constituency"),
        F.col("r_name").alias("state"),
        _house(key).alias("house"),
        allocated.alias("allocated_amount"),
        F.col("amount_recommended").cast("decimal(14,2)").alias("amount_recommended"),
        F.col("total_expenditure").cast("decimal(14,2)").alias("total_expenditure"),
        F.round(100 * F.try_divide(F.col("amount_recommended").cast("double"),
                                   allocated.cast("double")).cast("decimal(24,8)"), 2)
        .cast("double").alias("utilization_pct"),
        "completed_works",
        "recommended_works",
        F.round(100 * (F.col("completed_works") / F.col("recommended_works"))
                .cast("decimal(24,8)"), 2).cast("double").alias("completion_rate_pct"),
        (F.col("amount_recommended") - F.col("total_expenditure")).cast("decimal(14,2)")
        .alias("unspent_amount"),
        F.col("recommended_works").alias("transaction_count"),
        (F.col("recommended_works") - F.col("pending_payments")).alias("successful_payments"),
        "pending_payments",
    )


def similarity(works_df: DataFrame) -> DataFrame:
    """A deterministic similarity per work: another line of the same order, 0.900-1.000."""
    order_first = works_df.groupBy("order_id").agg(F.min("work_key").alias("first_key"))
    step = F.pmod(F.col("order_id") * 7 + F.length("work_key"), F.lit(101))
    return (
        works_df.select("work_key", "order_id").join(order_first, "order_id")
        .select(
            "work_key", "order_id",
            F.nullif("first_key", "work_key").alias("similar_work_key"),
            (F.lit(0.9) + step / 1000.0).cast("decimal(5,4)").cast("double")
            .alias("max_similarity_score"),
        )
    )


def review_events(spark: SparkSession, sf_dir: str, dealt: DataFrame | None = None,
                  parts: int | None = None) -> DataFrame:
    """Decisions and clears, one row per event and work it touches, with the order it names.

    An event of an order without works keeps a key that no work has. Events are dealt by order
    to as many ``parts`` as ``dealt`` lies in.
    """
    status = (
        F.when(F.col("event_type") == "click", "verified")
        .when(F.col("event_type") == "view", "dismissed")
        .when(F.col("event_type") == "error", "escalated")
        .when(F.col("event_type") == "signup", "pending")
    )
    events = (
        table(spark, sf_dir, "events").withColumn("status", status).filter("status is not null")
    )
    events = events.repartition(parts, "user_id") if parts else events
    keys = works(spark, sf_dir, dealt).select("order_id", "work_key")
    return events.join(keys, F.col("user_id") == F.col("order_id"), "left").select(
        "event_id",
        F.col("user_id").alias("order_id"),
        F.coalesce("work_key", F.concat(F.lit("order "), F.col("user_id").cast("string")))
        .alias("work_key"),
        "status",
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"),
        F.concat(F.lit("reviewer "), F.col("user_id").cast("string")).alias("reviewer"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
