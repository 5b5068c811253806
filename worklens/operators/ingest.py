"""Cleansing raw extracts into works, payments and members, with every reject kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, count_where
from ..functions.text import member_key
from ..params import Params
from ..sources.extracts import resolve_column

RUPEES = "(₹)"

# The spellings each published member figure has had, newest first.
MEMBER_FIELDS = {
    "allocated_amount": ([f"Allocated Amount {RUPEES}"], "decimal(18,2)"),
    "amount_recommended": ([f"Amount Recommended {RUPEES}"], "decimal(18,2)"),
    "total_expenditure": ([f"Total Expenditure {RUPEES}"], "decimal(18,2)"),
    "utilization_pct": (["Utilization %"], "double"),
    "completed_works": (["Completed Works"], "bigint"),
    "recommended_works": (["Recommended Works"], "bigint"),
    "completion_rate_pct": (["Completion Rate %"], "double"),
    "unspent_amount": ([f"Balance Not Yet Paid to Vendors {RUPEES}",
                        f"Unspent Amount {RUPEES}"], "decimal(18,2)"),
    "transaction_count": (["Transaction Count"], "bigint"),
    "successful_payments": (["Successful Payments"], "bigint"),
    "pending_payments": (["Pending Payments"], "bigint"),
}


def district(agency) -> Column:
    """The agency's name before its first parenthesis, upper-cased; all of it if that is empty."""
    whole = F.upper(F.trim(col(agency)))
    head = F.upper(F.trim(F.substring_index(col(agency), "(", 1)))
    return F.coalesce(F.nullif(head, F.lit("")), whole)


def iso_date(c) -> Column:
    """ISO-8601 date or timestamp as a UTC date, whatever zone the session has; else NULL.

    A time without a zone is UTC; one with a zone is counted in seconds since the epoch.
    """
    text = F.trim(col(c))
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    zoned = text.rlike(r"^\S+[T ].*([A-Za-z]|[+-]\d{1,2}(:?\d{2}){0,2})$")
    days = F.floor(F.unix_micros(text.try_cast("timestamp")) / F.lit(86_400_000_000)).cast("int")
    return F.when(shaped, F.when(zoned, F.date_from_unix_date(days)).otherwise(
        text.try_cast("timestamp_ntz").cast("date")))


def work_key(work_id, term, agency) -> Column:
    """Work ids restart per term and per agency, so all three make the key."""
    return F.concat_ws("|", col(work_id).cast("string"), col(term).cast("string"),
                       F.trim(col(agency)))


def tri_bool(c) -> Column:
    """True, false, or NULL for anything that is neither: unknown is never false."""
    return col(c).try_cast("boolean")


def expected_completion(start, days: int = 365) -> Column:
    return F.date_add(col(start), days)


def _with_term(df: DataFrame) -> DataFrame:
    return df if "ls_term" in df.columns else df.withColumn("ls_term", F.lit(0))


def unite_works(recommended: DataFrame, completed: DataFrame,
                ordinal: str | None = None, parts: int | None = None) -> DataFrame:
    """Both populations as one; a work in both keeps its completed row and the date it was
    recommended on (the first in file order where ``ordinal`` names the row number).

    With ``parts`` both are dealt by the work's key to as many parts, and lie so afterwards.
    """
    key = work_key("Work ID", "ls_term", "IDA")
    rec = _with_term(recommended).withColumn("work_key", key).withColumn(
        "start_date", iso_date("Recommendation Date"))
    com = _with_term(completed).withColumn("work_key", key)
    if parts:
        rec, com = rec.repartition(parts, "work_key"), com.repartition(parts, "work_key")
    dated = rec.filter(F.col("start_date").isNotNull()).groupBy("work_key")
    first = dated.agg((F.min_by("start_date", ordinal) if ordinal else F.min("start_date"))
                      .alias("start_date"))

    def shaped(df: DataFrame, status: str, amount: str, done: Column) -> DataFrame:
        return df.select(
            "work_key", F.col("Work Description").alias("description"),
            F.col("Category").alias("category"), F.col("MP Name").alias("mp_name"),
            F.col("House").alias("house"), F.col("ls_term").cast("int").alias("ls_term"),
            F.col("Constituency").alias("constituency"), F.col("State").alias("state"),
            F.col("IDA").alias("implementing_agency"),
            F.col(amount).cast("string").alias("amount"), F.lit(status).alias("work_status"),
            "start_date", done.alias("actual_completion"),
            F.col("Has Images").cast("string").alias("has_images"),
            F.col("source_file") if "source_file" in df.columns
            else F.lit(None).cast("string").alias("source_file"),
        )

    only_recommended = rec.join(com.select("work_key"), "work_key", "left_anti")
    return shaped(
        only_recommended, "recommended", f"Recommended Amount {RUPEES}",
        F.lit(None).cast("date"),
    ).unionByName(shaped(
        com.join(first, "work_key", "left"), "completed", f"Final Amount {RUPEES}",
        iso_date("Completed Date"),
    ))


def reject_reason(p: Params) -> Column:
    """The rule that decides comes first: amount rules, then description, then state."""
    amount = F.col("amount").try_cast("double")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when((amount > 0) & (amount < p.min_amount),
               f"Sanctioned amount below Rs {p.min_amount:.0f} floor")
        .when(amount <= 0, "Sanctioned amount is not positive")
        .when(amount.isNull() | F.isnan(amount), "Missing or non-numeric sanctioned amount")
        .when(blank("description"), "Missing or empty work description")
        .when(blank("state"), "Missing state")
    )


def route_rejects(united: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejected rows with their reason and the raw values)."""
    judged = united.withColumn("reason", reject_reason(p))
    raw = [c for c in united.columns if c != "source_file"]
    raw_row = F.map_from_arrays(
        F.array(*[F.lit(c) for c in raw]), F.array(*[F.col(c).cast("string") for c in raw]))
    rejects = judged.filter(F.col("reason").isNotNull()).select(
        raw_row.alias("raw_row"), "reason", "source_file")
    return judged.filter(F.col("reason").isNull()).drop("reason"), rejects


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Reasons of the latest extract, by the date in its file name."""
    dated = rejects.withColumn("day", F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})", 1))
    last = dated.agg(F.max(F.nullif("day", F.lit(""))).alias("last"))
    return (
        dated.join(F.broadcast(last), F.col("day") == F.col("last"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("rows").desc(), "reason")
    )


def derive_works(accepted: DataFrame, p: Params, source: str = "real",
                 ascii_only: bool = False) -> DataFrame:
    """Loadable works: the source's own fields and what follows from them directly."""
    amount = F.round(F.col("amount").try_cast("decimal(24,8)"), 2).cast("decimal(14,2)")
    return accepted.select(
        "work_key", F.trim("description").alias("description"), "ls_term", "mp_name",
        member_key("mp_name", "state", "house", ascii_only).alias("mp_id"), "house",
        "constituency", "state", district("implementing_agency").alias("district"),
        F.coalesce("category", F.lit("Unknown")).alias("category"), "implementing_agency",
        amount.alias("recommended_amount"), amount.alias("sanctioned_amount"),
        # A completed work's final amount is its expenditure; others have none recorded.
        F.when(F.col("work_status") == "completed", amount)
        .otherwise(F.lit(0).cast("decimal(14,2)")).alias("expenditure"),
        "work_status", "start_date",
        expected_completion("start_date", p.duration_days).alias("expected_completion"),
        "actual_completion", F.lit(source).alias("source"),
        tri_bool("has_images").alias("has_images"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the lowest by ``order``: a grouped minimum, so no task sorts a key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def one_per_key(df: DataFrame, key: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key where no file order tells which came first: the lowest by its values,
    so that a rerun keeps the same one.

    ``within`` names columns that the key determines: rows dealt by them are grouped where they
    lie, and are sorted a part at a time instead of all that a task reads.
    """
    rest = [c for c in df.columns if c != key and c not in within]
    picked = df.groupBy(*within, key).agg(F.min(F.struct(*rest)).alias("__row"))
    return picked.select(*within, key, "__row.*").select(*df.columns)


def clean_payments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payments, one-row tally). Rows without vendor, agency or positive amount are dropped:
    an unusable payment is no work that failed to load.
    """
    raw = raw if "ls_term" in raw.columns else raw.withColumn("ls_term", F.lit(None).cast("int"))
    amount = F.col(f"Expenditure Amount {RUPEES}").try_cast("decimal(24,8)")
    usable = (
        F.coalesce(amount > 0, F.lit(False))
        & (F.coalesce(F.trim("Vendor"), F.lit("")) != "")
        & (F.coalesce(F.trim("IDA"), F.lit("")) != "")
    )
    kept = raw.filter(usable).select(
        F.col("ls_term").cast("int").alias("ls_term"), F.col("MP Name").alias("mp_name"),
        F.col("Constituency").alias("constituency"), F.col("State").alias("state"),
        F.col("Work Description").alias("work_type_text"), F.trim("Vendor").alias("vendor"),
        F.trim("IDA").alias("implementing_agency"), district(F.trim("IDA")).alias("district"),
        F.round(amount, 2).cast("decimal(14,2)").alias("expenditure_amount"),
        iso_date("Expenditure Date").alias("expenditure_date"),
        F.col("Payment Status").alias("payment_status"),
    )
    tally = raw.agg(count_where(usable).alias("kept"), count_where(~usable).alias("dropped"))
    return kept, tally


def clean_members(raw: DataFrame, ordinal: str, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row per member and term, one-row tally of dropped and collapsed rows)."""
    raw = _with_term(raw)
    keyed = raw.select(
        member_key("MP Name", "State", "House", ascii_only).alias("mp_id"),
        F.col("ls_term").cast("int").alias("ls_term"), F.col("MP Name").alias("mp_name"),
        F.col("Constituency").alias("constituency"), F.col("State").alias("state"),
        F.col("House").alias("house"),
        *[resolve_column(raw, names, dtype).alias(field)
          for field, (names, dtype) in MEMBER_FIELDS.items()],
        F.col(ordinal).alias("__ordinal"),
    )
    named = keyed.filter(F.col("mp_id").isNotNull())
    rows = first_per_key(named, ["mp_id", "ls_term"], "__ordinal").drop("__ordinal")
    unnamed = count_where(F.col("mp_id").isNull())
    distinct = F.countDistinct("mp_id", "ls_term")
    tally = keyed.agg(unnamed.alias("dropped"),
                      (F.count("mp_id") - distinct).alias("collapsed"))
    return rows, tally


def require_key(works: DataFrame, key: str = "work_key") -> tuple[DataFrame, DataFrame]:
    """(works that can be scored, one-row count of those that cannot)."""
    return (works.filter(F.col(key).isNotNull()),
            works.agg(count_where(F.col(key).isNull()).alias("unkeyed")))


def duplicate_keys(works: DataFrame, key: str = "work_key") -> DataFrame:
    """Keys carried by more than one row: a loaded table has none."""
    return works.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
