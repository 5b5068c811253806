"""The review queue: one filter builder behind the page, the tiles and the export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, sum_where
from ..functions.text import contains_text
from ..params import Params

QUEUE_FLOOR = Params.medium_from
EXPORT_LIMIT, EXPORT_MAX = 5_000, 20_000

QUEUE_COLUMNS = [
    "work_key", "work_name", "description", "ls_term", "state", "district", "sector",
    "category", "implementing_agency", "mp_name", "constituency", "sanctioned_amount",
    "expenditure", "work_status", "delay_days", "cost_deviation_pct", "peer_median_cost",
    "peer_count", "max_similarity_score", "similar_work_key", "cost_risk", "delay_risk",
    "duplicate_risk", "agency_risk", "compliance_risk", "overall_risk_score", "risk_level",
    "flagged_reasons",
]

EXPORT_COLUMNS = [
    "work_key", "work_name", "state", "district", "sector", "implementing_agency", "mp_name",
    "work_status", "sanctioned_amount", "expenditure", "delay_days", "cost_deviation_pct",
    "risk_score", "risk_band", "review_status", "why_flagged",
]


PAGE_MAX = 200
STATUSES = ("pending", "verified", "dismissed", "escalated")
SUBJECTS = ("agency", "mp")


def within(limit: int, most: int) -> int:
    """The limit, or an error: rows are never left out without a word."""
    if not 0 <= limit <= most:
        raise ValueError(f"limit {limit} is not between 0 and {most}")
    return limit


def known(name: str, value, allowed):
    """The value, or an error if it is given and not one of those ``allowed``."""
    if value and value not in allowed:
        raise ValueError(f"{name} {value!r} is none of {', '.join(allowed)}")
    return value


def any_contains(columns: list[str], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_text(c, needle) for c in columns])


def with_reviews(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queue rows with their verdict; no verdict row is what ``pending`` means.

    Columns of the work that ``verdicts`` has beside its own go with the work's key and stand for
    a few works each, as an order does: where both tables are dealt by them, a row meets the
    verdicts of its order and takes its own, and no row is moved.
    """
    told = {"status": "__status", "note": "review_note", "reviewer": "review_reviewer",
            "updated_at": "review_updated_at"}
    near = [c for c in verdicts.columns if c in scored.columns and c not in ("work_key", *told)]
    if near:
        own = F.struct(*[F.col(c).alias(name) for c, name in told.items()])
        met = verdicts.groupBy(*near).agg(F.map_from_entries(
            F.collect_list(F.struct("work_key", own))).alias("__reviews"))
        joined = scored.join(met, near, "left").withColumn(
            "__review", F.try_element_at("__reviews", F.col("work_key")))
        joined = joined.withColumns({name: F.col(f"__review.{name}") for name in told.values()})
        joined = joined.drop("__reviews", "__review")
    else:
        joined = scored.join(verdicts.select(
            "work_key", *[F.col(c).alias(name) for c, name in told.items()]), "work_key", "left")
    return joined.withColumn("review_status", F.coalesce("__status", F.lit("pending")))


def alert_filters(
    reviewed: DataFrame, q: str | None = None, state=None, district=None, sector=None,
    risk_level=None, ls_term=None, status=None, min_score=None, mp_id=None, compliance=None,
) -> DataFrame:
    """An empty string is a filter like any other here; only None leaves one out."""
    out = reviewed
    if known("compliance", compliance, ("breach",)):
        out = out.filter(F.col("compliance_risk") > 0)
    if q:
        out = out.filter(any_contains(
            ["work_name", "description", "mp_name", "district", "state",
             "implementing_agency"], q))
    for name, value in (("state", state), ("district", district), ("sector", sector),
                        ("risk_level", risk_level), ("ls_term", ls_term), ("mp_id", mp_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if known("status", status, STATUSES):
        out = out.filter(F.col("review_status") == status)
    if min_score is not None:
        out = out.filter(F.col("overall_risk_score") >= float(min_score))
    return out


def queue_scope(band: str | None = None, min_score: float | None = None,
                floor: float = QUEUE_FLOOR) -> dict:
    """No band: the queue, from ``floor`` on. ``ALL``: everything. A named band: no floor."""
    if band == "ALL":
        return {"risk_level": None, "min_score": min_score}
    if band:
        return {"risk_level": band, "min_score": min_score}
    return {"risk_level": None, "min_score": floor if min_score is None else min_score}


def by_risk(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("overall_risk_score").desc_nulls_last(), F.col("work_key"))


def queue_page(scored: DataFrame, verdicts: DataFrame, limit: int = 50, offset: int = 0,
               **filters) -> DataFrame:
    page = by_risk(alert_filters(with_reviews(scored, verdicts), **filters))
    page = page.offset(offset) if offset else page
    return page.limit(within(limit, PAGE_MAX)).select(
        *QUEUE_COLUMNS, "review_status", "review_note", "review_reviewer", "review_updated_at")


def queue_total(scored: DataFrame, verdicts: DataFrame, **filters) -> DataFrame:
    """The verdicts are joined only where a filter asks for them."""
    rows = with_reviews(scored, verdicts) if filters.get("status") else scored
    return alert_filters(rows, **filters).agg(F.count(F.lit(1)).alias("total"))


def queue_summary(scored: DataFrame, verdicts: DataFrame, min_score: float = QUEUE_FLOOR,
                  **filters) -> DataFrame:
    scope = alert_filters(with_reviews(scored, verdicts), min_score=min_score, **filters)
    status = F.col("review_status")
    return scope.agg(
        F.count(F.lit(1)).alias("in_scope"),
        count_where(status == "pending").alias("pending"),
        count_where(status == "escalated").alias("escalated"),
        count_where(status == "verified").alias("verified"),
        count_where(status == "dismissed").alias("dismissed"),
        count_where(F.col("risk_level") == "HIGH").alias("high"),
        count_where(F.col("risk_level") == "MEDIUM").alias("medium"),
        sum_where(status == "pending", "sanctioned_amount").alias("pending_sanctioned_amount"),
    )


def summary_tiles(scored: DataFrame, verdicts: DataFrame, band: str | None = None,
                  status: str | None = None, **filters) -> DataFrame:
    """Tiles over the page's filters: they are the status filter, so they ignore it."""
    scope = queue_scope(band, filters.pop("min_score", None))
    return queue_summary(scored, verdicts, min_score=scope["min_score"] or 0.0,
                         risk_level=scope["risk_level"], **filters)


def _one_line(c) -> Column:
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))


def export_queue(scored: DataFrame, verdicts: DataFrame, limit: int = EXPORT_LIMIT,
                 min_score: float = QUEUE_FLOOR, **filters) -> DataFrame:
    """The filtered queue as flat rows: whitespace collapsed, so one record is one line."""
    rows = by_risk(alert_filters(with_reviews(scored, verdicts), min_score=min_score, **filters))
    rows = rows.limit(within(limit, EXPORT_MAX))
    flat = {"work_key", "work_name", "state", "district", "sector", "implementing_agency",
            "mp_name"}
    computed = {
        "risk_score": F.col("overall_risk_score"),
        "risk_band": F.col("risk_level"),
        "why_flagged": _one_line(F.array_join("flagged_reasons", " | ")),
    }
    return rows.select(*[
        computed[c].alias(c) if c in computed
        else _one_line(c).alias(c) if c in flat else F.col(c)
        for c in EXPORT_COLUMNS
    ])


def write_export(export: DataFrame, path: str) -> None:
    """One CSV file: the export is limited to ``EXPORT_MAX`` rows."""
    export.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


# ------------------------------------------------------------------ register


def register_filters(scored: DataFrame, q=None, state=None, district=None, risk_level=None,
                     ls_term=None) -> DataFrame:
    """The register ignores empty filters and searches the 60-character name only."""
    out = scored
    if q:
        out = out.filter(any_contains(
            ["work_name", "mp_name", "district", "state", "implementing_agency"], q))
    for name, value in (("state", state), ("district", district), ("risk_level", risk_level),
                        ("ls_term", ls_term)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def register_page(scored: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    page = by_risk(register_filters(scored, **filters))
    page = page.offset(offset) if offset else page
    return page.limit(within(limit, PAGE_MAX)).select(
        "work_key", "work_name", "ls_term", "state", "district", "category", "sector",
        "implementing_agency", "sanctioned_amount", "overall_risk_score", "risk_level")


def work_by_key(scored: DataFrame, work_key: str) -> DataFrame:
    return scored.filter(F.col("work_key") == work_key)


def top_works(scored: DataFrame, n: int, scope: Column | None = None) -> DataFrame:
    rows = scored if scope is None else scored.filter(scope)
    return by_risk(rows.filter(F.col("overall_risk_score").isNotNull())).limit(n)


def ticker(scored: DataFrame, verdicts: DataFrame, n: int = 18, high_from: float = 70.0) -> DataFrame:
    return queue_page(scored, verdicts, limit=n, risk_level="HIGH", min_score=high_from)


# ------------------------------------------------------------------ findings


def finding_filters(findings: DataFrame, code=None, subject_type=None, ls_term=None,
                    q=None) -> DataFrame:
    known("subject_type", subject_type, SUBJECTS)
    out = findings
    for name, value in (("code", code), ("subject_type", subject_type), ("ls_term", ls_term)):
        if value:
            out = out.filter(F.col(name) == value)
    return out.filter(any_contains(["subject", "headline"], q)) if q else out


def findings_page(findings: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    page = finding_filters(findings, **filters).orderBy(
        F.col("severity").desc(), "code", "subject", "ls_term", "period")
    page = page.offset(offset) if offset else page
    return page.limit(within(limit, PAGE_MAX))
