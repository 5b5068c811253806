"""Headline figures, rankings, trends, forecast and the member, state and district desks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (
    count_where, fiscal_start, mean_of, performance_band, rounded, safe_rate, share_of,
    sum_where, total,
)
from ..functions.risk import COMPLIANCE_RULES
from ..functions.text import OTHER, boundary_key, clean_name, seat
from ..operators.detectors import with_limits
from ..operators.quantiles import exact_percentiles
from ..params import Params
from ..session import cut
from .queue import top_works


def in_queue() -> Column:
    """The bands are cut by ``Params`` when works are scored, so the queue moves with them."""
    return F.col("risk_level").isin("MEDIUM", "HIGH")


def is_high() -> Column:
    return F.col("risk_level") == "HIGH"


def _term(df: DataFrame, ls_term: int | None) -> DataFrame:
    return df if ls_term is None else df.filter(F.col("ls_term") == ls_term)


def _beside(*one_row: DataFrame) -> DataFrame:
    """One-row aggregates side by side."""
    out = one_row[0]
    for other in one_row[1:]:
        out = out.join(F.broadcast(other))
    return out


# ----------------------------------------------------------------- headlines


def overview(scored, payments, members, ls_term: int | None = None,
             late_days: int = Params.late_days) -> DataFrame:
    """Three money figures that are not interchangeable, and the counts beside them."""
    done = F.col("work_status") == "completed"
    works = _term(scored, ls_term).agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(done).alias("completed_count"),
        count_where(F.col("work_status") == "recommended").alias("pending_count"),
        total("expenditure").alias("total_expenditure"),
        sum_where(done, "expenditure").alias("completed_works_value"),
        total("sanctioned_amount").alias("sanctioned_total"),
        count_where(is_high()).alias("high_risk_count"),
        count_where(F.col("delay_days") > late_days).alias("delayed_count"),
        count_where(in_queue()).alias("anomaly_count"),
    )
    money = _term(payments, ls_term).agg(
        total("expenditure_amount").alias("vendor_payments"),
        F.count(F.lit(1)).alias("payment_count"))
    people = _term(members, ls_term).agg(
        total("allocated_amount").alias("allocated_total"),
        F.countDistinct("mp_id").alias("mp_count"))
    return _beside(works, money, people)


def scoring_pending(overview_row: DataFrame) -> DataFrame:
    """Works exist but every risk count is zero: scoring has not run yet."""
    return overview_row.select((
        (F.col("total_projects") > 0) & (F.col("high_risk_count") == 0)
        & (F.col("delayed_count") == 0) & (F.col("anomaly_count") == 0)
    ).alias("scoring_pending"))


def aggregate_pending(rows: DataFrame, score: str, count: str) -> DataFrame:
    zero = (F.col(score) == 0) & (F.col(count) == 0)
    return rows.agg(F.coalesce(F.bool_and(zero), F.lit(False)).alias("scoring_pending"))


def filter_states(works) -> DataFrame:
    return works.groupBy("state").agg(F.count(F.lit(1)).alias("works")).orderBy("state")


def filter_bands(scored) -> DataFrame:
    return (scored.filter(F.col("risk_level").isNotNull()).select("risk_level").distinct()
            .orderBy("risk_level"))


def risk_rollup(scope: DataFrame) -> DataFrame:
    """Works-side totals of any scope, one definition for all of them.

    The scope is read once, down to one row for each district, agency and member that meet in a
    work; what is distinct is counted on those few rows, measure by measure, so that no work is
    copied for every measure.
    """
    measures = {"districts": "district", "agencies": "implementing_agency", "members": "mp_id"}
    score = F.col("overall_risk_score").cast("decimal(24,8)")
    counts = {
        "works": F.count(F.lit(1)),
        "completed": count_where(F.col("work_status") == "completed"),
        "pending": count_where(F.col("work_status") == "recommended"),
        "high_risk": count_where(is_high()),
        "in_queue": count_where(in_queue()),
        "scored": F.count(score),
    }
    sums = {
        "sanctioned": F.col("sanctioned_amount"),
        "expenditure": F.col("expenditure"),
        "flagged_amount": F.when(in_queue(), F.col("sanctioned_amount")),
        "score": score,
    }
    met = cut(scope.groupBy(*measures.values()).agg(
        *[c.alias(name) for name, c in counts.items()],
        *[F.sum(c).alias(name) for name, c in sums.items()]), "rollup")
    whole = met.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts if name != "scored"],
        *[total(name).alias(name) for name in sums if name != "score"],
        rounded(F.when(F.sum("scored") > 0, F.sum("score").cast("double") / F.sum("scored")), 1)
        .alias("avg_risk"))
    distinct = [met.agg(F.countDistinct(c).alias(name)) for name, c in measures.items()]
    return _beside(whole, *distinct).select(
        "works", "completed", "pending", "high_risk", "in_queue", "sanctioned", "expenditure",
        "flagged_amount", *measures, "avg_risk")


def queue_shares(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "works", share_of("in_queue", "works").alias("queue_share"),
        share_of("completed", "works").alias("completion_share"))


# ------------------------------------------------------------------ rankings


def state_map(scored) -> DataFrame:
    return scored.groupBy("state").agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(is_high()).alias("high_risk_count"),
        count_where(in_queue()).alias("flagged_count"),
        F.coalesce(mean_of("overall_risk_score", 4), F.lit(0.0)).alias("avg_risk_score"),
        safe_rate(count_where(in_queue()), F.count(F.lit(1))).alias("flagged_share"),
    )


def state_map_on(boundaries: DataFrame, scored, name: str = "boundary") -> DataFrame:
    """Boundary names with the figures of the state they stand for, NULL where unmatched."""
    stats = state_map(scored).withColumn("__k", boundary_key("state"))
    return boundaries.withColumn("__k", boundary_key(name)).join(stats, "__k", "left").drop("__k")


def agency_ranking(scored, profile, p: Params, ls_term=None, limit=100, offset=0) -> DataFrame:
    """Aggregate first, then join: the profile joins one row per (agency, term)."""
    stats = _term(scored, ls_term).groupBy("implementing_agency", "ls_term").agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(F.col("delay_days") > p.late_days).alias("delayed_count"),
        count_where(is_high()).alias("anomaly_count"),
        F.coalesce(mean_of("overall_risk_score", 4), F.lit(0.0)).alias("avg_risk_score"),
    ).filter(F.col("total_projects") >= p.agency_min_works)
    vendor = profile.select(
        "implementing_agency", "ls_term", "vendor_count", "transaction_count", "total_spend",
        "top_vendor", "top_vendor_share_pct", "concentration_risk")
    ranked = (
        stats.join(vendor, ["implementing_agency", "ls_term"], "left")
        .withColumn("concentration_risk", F.coalesce("concentration_risk", F.lit(0.0)))
        .orderBy(F.col("avg_risk_score").desc(), F.col("total_projects").desc(),
                 "implementing_agency", "ls_term")
    )
    return (ranked.offset(offset) if offset else ranked).limit(limit)


def member_balances(members, scored, limit=100) -> DataFrame:
    """Members by allocation never committed to a work."""
    stats = scored.filter(F.col("mp_id").isNotNull()).groupBy("mp_id", "ls_term").agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(is_high()).alias("high_risk_works"))
    return (
        members.filter(F.coalesce(F.col("allocated_amount"), F.lit(0)) > 0)
        .join(stats, ["mp_id", "ls_term"], "left")
        .select(
            "mp_id", "ls_term", "mp_name", "constituency", "state", "house",
            "allocated_amount", "amount_recommended", "total_expenditure", "utilization_pct",
            "unspent_amount", "completion_rate_pct", "pending_payments",
            (F.col("allocated_amount") - F.col("amount_recommended")).alias("idle_amount"),
            F.coalesce("total_projects", F.lit(0)).alias("total_projects"),
            F.coalesce("high_risk_works", F.lit(0)).alias("high_risk_works"))
        .orderBy(F.col("idle_amount").desc_nulls_last(), "mp_id", "ls_term").limit(limit)
    )


def member_directory(members, scored, ls_term: int) -> DataFrame:
    stats = _term(scored, ls_term).filter(F.col("mp_id").isNotNull()).groupBy("mp_id").agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(F.col("work_status") == "completed").alias("completed_projects"),
        count_where(is_high()).alias("high_risk_works"),
        count_where(in_queue()).alias("in_queue"),
        F.countDistinct("district").alias("districts"))
    counts = ["total_projects", "completed_projects", "high_risk_works", "in_queue", "districts"]
    return _term(members, ls_term).join(stats, "mp_id", "left").select(
        "mp_id", "ls_term", "mp_name", "constituency", "state", "house", "allocated_amount",
        "amount_recommended", "total_expenditure", "unspent_amount", "completion_rate_pct",
        "completed_works", "recommended_works", "transaction_count", "pending_payments",
        (F.col("allocated_amount") - F.col("amount_recommended")).alias("idle_amount"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def district_ranking(scored) -> DataFrame:
    return scored.groupBy("state", "district").agg(
        F.count(F.lit(1)).alias("total_projects"),
        count_where(is_high()).alias("high_risk_count"),
        F.coalesce(mean_of("overall_risk_score", 4), F.lit(0.0)).alias("avg_risk_score"),
    ).orderBy(F.col("avg_risk_score").desc(), "state", "district")


def _member_money(members) -> list[Column]:
    return [
        F.sum("allocated_amount").cast("double").alias("allocated"),
        F.sum("amount_recommended").cast("double").alias("recommended"),
        F.sum("total_expenditure").cast("double").alias("expenditure"),
        F.countDistinct("mp_id").alias("mp_count"),
        F.sum("completed_works").alias("completed_works"),
        F.sum("recommended_works").alias("recommended_works"),
    ]


def state_league(members, scored, ls_term: int) -> DataFrame:
    """Members' money per state beside what scoring adds; paid and committed kept apart."""
    money = _term(members, ls_term).filter(F.col("state").isNotNull()).groupBy("state").agg(
        *_member_money(members))
    stats = _term(scored, ls_term).groupBy("state").agg(
        F.count(F.lit(1)).alias("works"),
        count_where(is_high()).alias("high_risk"),
        count_where(in_queue()).alias("in_queue"),
        sum_where(in_queue(), "sanctioned_amount").alias("flagged_amount"),
        mean_of("overall_risk_score", 1).alias("avg_risk"))
    return money.join(stats, "state", "left").select(
        "state", "allocated", "recommended", "expenditure", "mp_count", "completed_works",
        "recommended_works",
        safe_rate("expenditure", "allocated").alias("paid_rate"),
        safe_rate("recommended", "allocated").alias("committed_rate"),
        safe_rate("completed_works", "recommended_works").alias("completion_rate"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("works", "high_risk", "in_queue")],
        F.coalesce("flagged_amount", F.lit(0.0)).alias("flagged_amount"), "avg_risk")


STATE_MEASURES = {
    "paid": "paid_rate", "committed": "committed_rate", "completion": "completion_rate",
    "allocated": "allocated", "queue": "in_queue",
}


def rank_states(league: DataFrame, by: str = "paid") -> DataFrame:
    """Ranked by one of five measures; a missing figure ranks as -1."""
    measure = F.col(STATE_MEASURES[by])
    return league.withColumn("band", performance_band("paid_rate")).orderBy(
        F.coalesce(measure, F.lit(-1)).desc(), "state")


# ---------------------------------------------------------------- directory


def member_cards(directory: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Directory rows as cards: cleaned name, seat, both rates, party where matched."""
    if profiles is None:
        directory = directory.withColumns({
            c: F.lit(None).cast("string")
            for c in ("profile_name", "party", "party_short", "status")})
    else:
        directory = directory.join(profiles, "mp_id", "left")
    return directory.select(
        F.col("mp_id").alias("id"), F.col("ls_term").alias("term"),
        F.coalesce(F.nullif("profile_name", F.lit("")), clean_name("mp_name")).alias("name"),
        "party", "party_short", "house", seat("constituency", "house").alias("seat"), "state",
        F.col("allocated_amount").cast("double").alias("allocated"),
        F.col("amount_recommended").cast("double").alias("committed"),
        F.col("total_expenditure").cast("double").alias("paid"),
        F.col("idle_amount").cast("double").alias("idle"),
        safe_rate("amount_recommended", "allocated_amount", 4).alias("committed_rate"),
        safe_rate("total_expenditure", "allocated_amount", 4).alias("paid_rate"),
        F.col("total_projects").alias("works"), "in_queue",
        F.col("high_risk_works").alias("high_risk"), "status", F.lit(False).alias("unlisted"))


def with_unlisted(cards: DataFrame, unlisted: DataFrame, term: int,
                  current: int = Params.current_term) -> DataFrame:
    """Sitting members without a fund record, in the current term only: no money at all."""
    if term != current:
        return cards
    extra = unlisted.select(
        "id", F.lit(term).alias("term"), "name", "party", "party_short", "house", "seat", "state",
        "status", F.lit(0).cast("bigint").alias("works"),
        F.lit(0).cast("bigint").alias("in_queue"), F.lit(0).cast("bigint").alias("high_risk"),
        F.lit(True).alias("unlisted"))
    return cards.unionByName(extra, allowMissingColumns=True)


DIRECTORY_SORTS = {
    "name": (F.lower, "name", True), "allocated": (None, "allocated", False),
    "paid": (None, "paid_rate", False), "committed": (None, "committed_rate", False),
    "idle": (None, "idle", False), "works": (None, "works", False),
    "queue": (None, "in_queue", False),
}


def _card_match(needle: str, with_state: bool) -> Column:
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
    match = has("name") | has("seat")
    match = match | F.coalesce(F.lower("party_short") == needle, F.lit(False))
    return match | has("state") | has("party") if with_state else match


def directory(cards: DataFrame, q=None, house=None, state=None, party=None,
              sort: str = "name") -> DataFrame:
    """Filtered cards, missing values last whichever way the sort runs."""
    out = cards
    for name, value in (("house", house), ("state", state), ("party", party)):
        if value:
            out = out.filter(F.col(name) == value)
    needle = (q or "").strip().lower()
    if needle:
        out = out.filter(_card_match(needle, True))
    wrap, name, ascending = DIRECTORY_SORTS[sort]
    key = wrap(F.col(name)) if wrap else F.col(name)
    first = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return out.orderBy(first, "name", "id")


def suggest(cards: DataFrame, q: str, exclude=(), limit: int = 6) -> DataFrame:
    needle = q.strip().lower()
    if not needle:
        return cards.limit(0)
    starts = F.startswith(F.lower("name"), F.lit(needle))
    rest = cards.filter(~F.col("id").isin(*exclude)) if exclude else cards
    return rest.filter(_card_match(needle, False)).orderBy(starts.desc(), "name", "id").limit(limit)


def parties_by_size(cards: DataFrame) -> DataFrame:
    return (cards.filter(F.coalesce(F.length("party"), F.lit(0)) > 0).groupBy("party")
            .agg(F.count(F.lit(1)).alias("members"))
            .orderBy(F.col("members").desc(), "party"))


def member_count(members, unlisted: DataFrame, ls_term: int | None,
                 current: int = Params.current_term) -> DataFrame:
    """Members with a fund record, and in the current term those seated without one."""
    listed = _term(members, ls_term).agg(F.countDistinct("mp_id").alias("with_record"))
    if ls_term not in (None, current):
        return listed.select("with_record", F.col("with_record").alias("members"))
    extra = unlisted.agg(F.count(F.lit(1)).alias("__u"))
    return _beside(listed, extra).select(
        "with_record", (F.col("with_record") + F.col("__u")).alias("members"))


COMPARED = ["allocated", "committed", "paid", "idle", "works", "in_queue", "high_risk"]


def compare_members(cards: DataFrame, ids: list[str]) -> DataFrame:
    """Two to four members in long form: each figure and its bar against the row's largest."""
    if not 2 <= len(ids) <= 4:
        raise ValueError(f"two to four members are compared, not {len(ids)}")
    chosen = cards.filter(F.col("id").isin(*ids))
    measures = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
        for c in COMPARED]))
    rows = chosen.select("id", "name", "unlisted", measures.alias("m")).select(
        "id", "name", "unlisted", "m.measure",
        F.when(~F.col("unlisted"), F.col("m.value")).alias("value"))
    # At most four rows per measure.
    peak = rows.groupBy("measure").agg(F.max(F.coalesce("value", F.lit(0.0))).alias("peak"))
    bar = F.when((F.col("peak") > 0) & ~F.col("unlisted"),
                 rounded(F.coalesce("value", F.lit(0.0)) / F.col("peak") * 100, 2))
    return rows.join(F.broadcast(peak), "measure").select(
        "id", "name", "measure", "value", bar.alias("bar_pct"))


def default_term(members, mp_id: str, wanted: int | None = None) -> DataFrame:
    """The wanted term where the member holds it, else the latest."""
    rank = F.struct((F.col("ls_term") == F.lit(wanted if wanted is not None else -1)).alias("w"),
                    F.col("ls_term"))
    return members.filter(F.col("mp_id") == mp_id).groupBy("mp_id").agg(
        F.max_by("ls_term", rank).alias("ls_term"))


# ------------------------------------------------------- forecast and trends


def late_forecast(scored, p: Params) -> tuple[DataFrame, DataFrame]:
    """(summary, worst agencies): works due soon at agencies in the worst quarter by overdue share."""
    today = F.lit(p.as_of)
    due = F.col("expected_completion").between(today, F.date_add(today, p.forecast_days))
    open_works = scored.filter(F.col("work_status") == "recommended")
    rated = (
        open_works.filter(F.col("expected_completion").isNotNull())
        .groupBy("implementing_agency").agg(
            F.count(F.lit(1)).alias("open_n"),
            count_where(F.col("expected_completion") < today).alias("overdue_n"))
        .filter(F.col("open_n") >= p.forecast_min_open)
        .withColumn("share", F.col("overdue_n") / F.col("open_n"))
    )
    line = exact_percentiles(rated, [], "share", {"cutoff_share": p.forecast_quantile},
                            "agencies_rated")
    worst = rated.join(F.broadcast(line)).filter(F.col("share") >= F.col("cutoff_share"))
    at_risk = open_works.filter(due).join(
        worst.select("implementing_agency", "share", "open_n", "overdue_n"),
        "implementing_agency")
    late = at_risk.agg(
        F.count(F.lit(1)).alias("likely_late"),
        F.countDistinct("implementing_agency").alias("agencies"),
        total("sanctioned_amount").alias("sanctioned"))
    in_window = open_works.filter(due).agg(F.count(F.lit(1)).alias("due_in_window"))
    summary = _beside(in_window, late).join(F.broadcast(line), how="left").select(
        rounded("cutoff_share", 6).alias("cutoff_share"),
        F.coalesce("agencies_rated", F.lit(0)).alias("agencies_rated"),
        "due_in_window", "likely_late", "agencies", "sanctioned",
        F.coalesce(rounded(F.col("cutoff_share") * 100, 1), F.lit(0.0)).alias("cutoff_pct"))
    agencies = at_risk.groupBy("implementing_agency").agg(
        F.min("state").alias("state"),
        rounded(F.max("share") * 100, 1).alias("overdue_pct"),
        F.max("open_n").alias("open_works"),
        F.max("overdue_n").alias("overdue_works"),
        F.count(F.lit(1)).alias("due_works"),
        total("sanctioned_amount").alias("due_sanctioned"),
        F.min("expected_completion").alias("next_due"),
        F.max("share").alias("__share"),
    ).orderBy(F.col("__share").desc(), F.col("due_works").desc(), "implementing_agency").limit(6)
    return summary, agencies.drop("__share")


def monthly(payments, state: str | None = None) -> DataFrame:
    dated = payments.filter(F.col("expenditure_date").isNotNull())
    dated = dated if state is None else dated.filter(F.col("state") == state)
    return dated.groupBy(F.date_format("expenditure_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("payments"), total("expenditure_amount").alias("amount"),
    ).orderBy("month")


def month_bars(months: DataFrame) -> DataFrame:
    """Each month relative to the peak month (a one-row aggregate), March marked."""
    peak = months.agg(F.greatest(F.max("amount"), F.lit(1.0)).alias("peak"))
    return months.join(F.broadcast(peak)).select(
        "month", "amount",
        rounded(F.greatest(F.col("amount") / F.col("peak") * 100, F.lit(2.0)), 4).alias("height"),
        (F.substring("month", 6, 2) == "03").alias("is_march"))


def fiscal(payments, state: str | None = None) -> DataFrame:
    dated = payments.filter(F.col("expenditure_date").isNotNull())
    dated = dated if state is None else dated.filter(F.col("state") == state)
    march = count_where(F.month("expenditure_date") == 3)
    return dated.groupBy(fiscal_start("expenditure_date").alias("fy")).agg(
        F.count(F.lit(1)).alias("payments"), total("expenditure_amount").alias("amount"),
        safe_rate(march, F.count(F.lit(1))).alias("march_share"),
        F.min("expenditure_date").alias("first_payment"),
        F.max("expenditure_date").alias("last_payment"),
    ).orderBy("fy")


def closed_years(years: DataFrame) -> DataFrame:
    """Fiscal years with a March share, without the last one: it is still running."""
    shown = years.filter(F.col("march_share").isNotNull())
    last = shown.agg(F.max("fy").alias("__last"))
    return shown.join(F.broadcast(last)).filter(F.col("fy") < F.col("__last")).drop("__last")


def gone_quiet(payments, works, p: Params, state: str | None = None, limit: int = 50) -> DataFrame:
    """Agencies holding open works whose last payment is long past."""
    in_state = (lambda d: d) if state is None else (lambda d: d.filter(F.col("state") == state))
    last = in_state(payments).groupBy("implementing_agency").agg(
        F.max("expenditure_date").alias("last_paid"), F.count(F.lit(1)).alias("payments"))
    open_work = F.col("work_status") == "recommended"
    held = in_state(works).groupBy("implementing_agency").agg(
        count_where(open_work).alias("open_works"),
        sum_where(open_work, "sanctioned_amount").alias("open_value"))
    since = F.date_sub(F.lit(p.as_of), p.quiet_days)
    return (
        last.filter(F.col("last_paid") < since)
        .join(held.filter(F.col("open_works") >= p.quiet_min_open), "implementing_agency")
        .select("implementing_agency", "last_paid", "payments", "open_works", "open_value",
                F.datediff(F.lit(p.as_of), "last_paid").alias("days_silent"))
        .orderBy(F.col("open_value").desc(), "implementing_agency").limit(limit)
    )


# ---------------------------------------------------------------- compliance


def compliance_book(works, scored, rules=COMPLIANCE_RULES) -> DataFrame:
    """Breaches per rule. ``clear``: the data satisfies it. ``inert``: it cannot be told."""
    spark = works.sparkSession
    caught = scored.agg(*[
        count_where(F.array_contains("flagged_reasons", r.reason)).alias(f"b{i}")
        for i, r in enumerate(rules)])
    possible = works.agg(*[
        count_where(F.coalesce(r.breach(), F.lit(False))).alias(f"p{i}")
        for i, r in enumerate(rules)])
    book = spark.createDataFrame(
        [(i, r.code, r.name, r.weight, r.can_fire) for i, r in enumerate(rules)],
        "i int, code string, rule string, weight int, can_fire boolean")
    counts = _beside(caught, possible)
    by_rule = lambda mark: F.element_at(
        F.array(*[F.col(f"{mark}{i}") for i in range(len(rules))]), F.col("i") + 1)
    rows = book.join(F.broadcast(counts)).withColumns(
        {"breaches": by_rule("b"), "possible": by_rule("p")})
    status = (
        F.when(F.col("breaches") > 0, "breached")
        .when((F.col("possible") == 0) & F.col("can_fire"), "clear").otherwise("inert"))
    return rows.select("code", "rule", "weight", "breaches", status.alias("status"))


def compliance_totals(scored, p: Params) -> DataFrame:
    return scored.agg(
        F.count("overall_risk_score").alias("works_scored"),
        count_where(F.col("compliance_risk") > 0).alias("works_breaching"),
        F.lit(int(round(p.weight_compliance * 100))).alias("weight_in_score"))


# --------------------------------------------------------------------- desks


def top_sectors(scope: DataFrame, n: int) -> DataFrame:
    return scope.groupBy(F.coalesce("sector", F.lit(OTHER)).alias("sector")).agg(
        F.count(F.lit(1)).alias("works"), total("sanctioned_amount").alias("sanctioned"),
        count_where(in_queue()).alias("in_queue"),
    ).orderBy(F.col("works").desc(), "sector").limit(n)


def _ranked_findings(findings: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = findings.orderBy(F.col("severity").desc(), "code", "subject", "ls_term", "period")
    return ranked if limit is None else ranked.limit(limit)


def member_desk(members, scored, findings, mp_id: str, ls_term: int | None = None) -> dict:
    own = _term(scored.filter(F.col("mp_id") == mp_id), ls_term)
    terms = members.filter(F.col("mp_id") == mp_id).select(
        "mp_id", "ls_term", "mp_name", "constituency", "state", "house", "allocated_amount",
        "amount_recommended", "total_expenditure", "utilization_pct", "completion_rate_pct",
        "unspent_amount",
        (F.col("allocated_amount") - F.col("amount_recommended")).alias("idle_amount"),
        "completed_works", "recommended_works", "pending_payments",
    ).orderBy(F.col("ls_term").desc())
    works = risk_rollup(own).select(
        "works", "completed", "pending", "high_risk", "in_queue", "sanctioned",
        F.col("flagged_amount").alias("flagged_value"), "districts", "agencies")
    found = findings.filter((F.col("subject_type") == "mp") & (F.col("subject") == mp_id))
    return {
        "terms": terms, "works": works,
        "sectors": top_sectors(own, 8).drop("in_queue"),
        "top_flagged": top_works(own, 10).select(
            "work_key", "work_name", "district", "sanctioned_amount", "overall_risk_score",
            "risk_level", "flagged_reasons"),
        "findings": with_limits(_ranked_findings(found)).select(
            "code", "headline", "severity", "detector_name", "limit"),
    }


def state_members(members, scored, state: str, ls_term: int) -> DataFrame:
    """Members by money actually out of the door; no rate sorts first."""
    here = (F.col("state") == state) & (F.col("ls_term") == ls_term)
    stats = scored.filter(here).groupBy("mp_id").agg(
        F.count(F.lit(1)).alias("works"), count_where(in_queue()).alias("in_queue"))
    return members.filter(here).join(stats, "mp_id", "left").select(
        "mp_id", "mp_name", "constituency", "house", "allocated_amount", "total_expenditure",
        "utilization_pct", "completion_rate_pct",
        safe_rate("total_expenditure", "allocated_amount").alias("paid_pct"),
        (F.col("allocated_amount") - F.col("amount_recommended")).alias("idle_amount"),
        F.coalesce("works", F.lit(0)).alias("works"),
        F.coalesce("in_queue", F.lit(0)).alias("in_queue"),
    ).orderBy(F.col("paid_pct").asc_nulls_first(), "mp_id")


def state_findings(findings, works, members, state: str, ls_term: int, limit=25) -> DataFrame:
    """Findings about the state's agencies or its members: two semi joins, not one OR."""
    here = (F.col("state") == state) & (F.col("ls_term") == ls_term)
    current = findings.filter(F.col("ls_term") == ls_term)
    agencies = works.filter(here).select(F.col("implementing_agency").alias("subject")).distinct()
    people = members.filter(here).select(F.col("mp_id").alias("subject"))
    found = (
        current.filter(F.col("subject_type") == "agency").join(agencies, "subject", "left_semi")
        .unionByName(current.filter(F.col("subject_type") == "mp")
                     .join(people, "subject", "left_semi"))
    )
    return with_limits(_ranked_findings(found, limit)).select(
        "code", "subject_type", "subject", "period", "severity", "headline", "detector_name",
        "limit")


def district_findings(findings, works, state: str, district: str, ls_term: int,
                      limit=20) -> DataFrame:
    agencies = works.filter(
        (F.col("state") == state) & (F.col("district") == district)
        & (F.col("ls_term") == ls_term)
    ).select(F.col("implementing_agency").alias("subject")).distinct()
    found = findings.filter(
        (F.col("ls_term") == ls_term) & (F.col("subject_type") == "agency")
    ).join(agencies, "subject", "left_semi")
    return with_limits(_ranked_findings(found, limit)).select(
        "code", "subject_type", "subject", "period", "severity", "headline", "detector_name",
        "limit")


def state_districts(scored, state: str, ls_term: int) -> DataFrame:
    here = (F.col("state") == state) & (F.col("ls_term") == ls_term)
    return scored.filter(here & F.col("district").isNotNull()).groupBy("district").agg(
        F.count(F.lit(1)).alias("works"),
        count_where(F.col("work_status") == "completed").alias("completed"),
        count_where(is_high()).alias("high_risk"),
        count_where(in_queue()).alias("in_queue"),
        total("sanctioned_amount").alias("sanctioned"),
        sum_where(in_queue(), "sanctioned_amount").alias("flagged_amount"),
        F.countDistinct("implementing_agency").alias("agencies"),
        mean_of("overall_risk_score", 1).alias("avg_risk"),
    ).orderBy(F.col("in_queue").desc(), F.col("works").desc(), "district")


def state_desk(members, scored, works, findings, state: str, ls_term: int) -> dict:
    here = (F.col("state") == state) & (F.col("ls_term") == ls_term)
    own = scored.filter(here)
    return {
        "money": members.filter(here).agg(*_member_money(members)),
        "works": risk_rollup(own),
        "districts": state_districts(scored, state, ls_term),
        "members": state_members(members, scored, state, ls_term),
        "sectors": top_sectors(own, 10),
        "top_flagged": top_works(own, 10).select(
            "work_key", "work_name", "district", "implementing_agency", "mp_name",
            "sanctioned_amount", "overall_risk_score", "risk_level", "flagged_reasons"),
        "findings": state_findings(findings, works, members, state, ls_term),
    }


def district_agencies(scored, profile, state: str, district: str, ls_term: int) -> DataFrame:
    here = ((F.col("state") == state) & (F.col("district") == district)
            & (F.col("ls_term") == ls_term))
    stats = scored.filter(here).groupBy("implementing_agency", "ls_term").agg(
        F.count(F.lit(1)).alias("works"),
        count_where(F.col("work_status") == "completed").alias("completed"),
        count_where(is_high()).alias("high_risk"),
        count_where(in_queue()).alias("in_queue"),
        total("sanctioned_amount").alias("sanctioned"),
        mean_of("overall_risk_score", 1).alias("avg_risk"))
    vendor = profile.select("implementing_agency", "ls_term", "vendor_count", "top_vendor",
                            "top_vendor_share_pct")
    return stats.join(vendor, ["implementing_agency", "ls_term"], "left").drop("ls_term").orderBy(
        F.col("in_queue").desc(), F.col("works").desc(), "implementing_agency")


def district_members(scored, state: str, district: str, ls_term: int, n: int = 12) -> DataFrame:
    here = ((F.col("state") == state) & (F.col("district") == district)
            & (F.col("ls_term") == ls_term))
    return scored.filter(here & F.col("mp_id").isNotNull()).groupBy("mp_id").agg(
        F.max("mp_name").alias("mp_name"), F.max("constituency").alias("constituency"),
        F.count(F.lit(1)).alias("works"), count_where(in_queue()).alias("in_queue"),
        total("sanctioned_amount").alias("sanctioned"),
    ).orderBy(F.col("works").desc(), "mp_id").limit(n)


def district_desk(scored, works, profile, findings, state: str, district: str,
                  ls_term: int) -> dict:
    here = ((F.col("state") == state) & (F.col("district") == district)
            & (F.col("ls_term") == ls_term))
    own = scored.filter(here)
    return {
        "works": risk_rollup(own),
        "agencies": district_agencies(scored, profile, state, district, ls_term),
        "sectors": top_sectors(own, 10),
        "members": district_members(scored, state, district, ls_term),
        "top_flagged": top_works(own, 15).select(
            "work_key", "work_name", "implementing_agency", "mp_name", "sector", "work_status",
            "sanctioned_amount", "expenditure", "delay_days", "cost_deviation_pct",
            "overall_risk_score", "risk_level", "flagged_reasons"),
        "findings": district_findings(findings, works, state, district, ls_term),
    }
