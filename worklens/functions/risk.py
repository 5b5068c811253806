"""The five risk components, the overall score, its band and its reasons."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params
from .numeric import clamp, col, ramp, rounded

RUPEE = "₹"


# ---------------------------------------------------------------- components


def delay_days(expected, actual, as_of) -> Column:
    """Days past the expected completion, 0 when early or when nothing was expected."""
    end = F.coalesce(col(actual), F.lit(as_of))
    days = F.datediff(end, col(expected))
    return F.coalesce(F.greatest(days, F.lit(0)), F.lit(0))


def expenditure_ratio(expenditure, sanctioned) -> Column:
    ratio = F.try_divide(col(expenditure).cast("double"), col(sanctioned).cast("double"))
    return rounded(ratio, 4)


def cost_risk(deviation, peers, min_peers: int = 8) -> Column:
    dev = F.coalesce(col(deviation), F.lit(0.0))
    return F.when(col(peers) < min_peers, F.lit(0.0)).otherwise(clamp(dev))


def delay_risk(days, full_days: int = 180) -> Column:
    return F.least(col(days) / F.lit(float(full_days)) * 100, F.lit(100.0))


def duplicate_risk(similarity, floor: float = 0.94) -> Column:
    """Similarity between the floor and 1 mapped onto 0-100, 0 below the floor."""
    sim = F.coalesce(col(similarity), F.lit(0.0))
    scaled = (sim - F.lit(floor)) / F.lit(1.0 - floor) * 100
    return F.when(sim < floor, F.lit(0.0)).otherwise(clamp(scaled))


def concentration_risk(hhi, transactions, p: Params) -> Column:
    enough = F.coalesce(col(transactions) >= p.min_transactions, F.lit(False))
    return F.when(enough, rounded(ramp(hhi, p.hhi_floor, p.hhi_ceiling), 2)).otherwise(F.lit(0.0))


def pending_risk(oldest_days, p: Params) -> Column:
    return rounded(ramp(oldest_days, p.pending_floor_days, p.pending_ceiling_days), 2)


def agency_risk(delay_rate, concentration, oldest_pending_days, p: Params) -> Column:
    """The worst of the agency's signals. A blend would dilute each of them."""
    return rounded(
        F.greatest(
            _delay_signal(delay_rate),
            F.coalesce(col(concentration), F.lit(0.0)),
            pending_risk(oldest_pending_days, p),
        ),
        2,
    )


def _delay_signal(delay_rate) -> Column:
    return F.least(F.coalesce(col(delay_rate), F.lit(0.0)), F.lit(100.0))


def overall_score(p: Params, cost="cost_risk", delay="delay_risk", duplicate="duplicate_risk",
                  agency="agency_risk", compliance="compliance_risk") -> Column:
    return rounded(
        col(cost) * p.weight_cost
        + col(delay) * p.weight_delay
        + col(duplicate) * p.weight_duplicate
        + col(agency) * p.weight_agency
        + col(compliance) * p.weight_compliance,
        2,
    )


def risk_level(score, medium_from: float = 40.0, high_from: float = 70.0) -> Column:
    s = col(score)
    return (
        F.when(s < medium_from, "LOW").when(s < high_from, "MEDIUM").when(s.isNotNull(), "HIGH")
    )


def near_duplicate(similarity, floor: float = 0.94) -> Column:
    return F.coalesce(col(similarity) >= floor, F.lit(False))


def has_peers(peers, min_peers: int = 8) -> Column:
    return F.coalesce(col(peers) >= min_peers, F.lit(False))


# ---------------------------------------------------------------- compliance


@dataclass(frozen=True)
class ComplianceRule:
    code: str
    name: str
    weight: int
    reason: str
    breach: Callable[[], Column]
    # Rules the published record can never break report "inert", not "clear".
    can_fire: bool = True


# The rule book.
COMPLIANCE_RULES = [
    ComplianceRule(
        "C-01", "Spending beyond the sanction", 60, "Expenditure exceeds sanctioned amount",
        lambda: F.col("expenditure") > F.col("sanctioned_amount"), can_fire=False,
    ),
    ComplianceRule(
        "C-02", "Recommended work with no schedule", 20,
        "Missing start or expected completion date",
        lambda: (F.col("work_status") == "recommended")
        & (F.col("start_date").isNull() | F.col("expected_completion").isNull()),
    ),
    ComplianceRule(
        "C-03", "Completed with no completion date", 20,
        "Marked completed with no actual completion date",
        lambda: (F.col("work_status") == "completed") & F.col("actual_completion").isNull(),
    ),
    ComplianceRule(
        "C-04", "Completed with no photograph", 30,
        "Completed work has no photographic documentation on record",
        lambda: (F.col("work_status") == "completed") & F.col("has_images").eqNullSafe(F.lit(False)),
    ),
]


def _breaches(rule: ComplianceRule) -> Column:
    return F.coalesce(rule.breach(), F.lit(False))


def compliance_risk(rules=COMPLIANCE_RULES) -> Column:
    points = F.lit(0.0)
    for rule in rules:
        points = points + F.when(_breaches(rule), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
    return F.least(points, F.lit(100.0))


def compliance_reasons(rules=COMPLIANCE_RULES) -> Column:
    return F.array_compact(F.array(*[F.when(_breaches(r), F.lit(r.reason)) for r in rules]))


# ------------------------------------------------------------------- reasons


def whole(c) -> Column:
    return rounded(c, 0).cast("bigint").cast("string")


def grouped(c) -> Column:
    return F.format_number(rounded(c, 0).cast("bigint"), 0)


def counted(n, word: str) -> Column:
    number = col(n).cast("bigint")
    return F.concat(
        number.cast("string"), F.when(number == 1, f" {word}").otherwise(f" {word}s")
    )


def concentration_reason(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    sentence = F.concat(
        whole(c("top_vendor_share_pct")), F.lit(f"% of this agency's {RUPEE}"),
        grouped(c("total_spend")), F.lit(" spend went to one vendor ("),
        c("top_vendor"), F.lit("), across "), counted(c("vendor_count"), "vendor"),
        F.lit(" and "), counted(c("transaction_count"), "transaction"),
    )
    return F.when(F.coalesce(c("concentration_risk"), F.lit(0.0)) > 0, sentence)


def pending_reason(p: Params, prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    sentence = F.concat(
        counted(c("pending_count"), "payment"), F.lit(" still in progress, oldest "),
        c("oldest_pending_days").cast("bigint").cast("string"), F.lit(" days"),
    )
    return F.when(pending_risk(c("oldest_pending_days"), p) > 0, sentence)


FOREST_REASON = (
    "Unusual combination of sanctioned amount, delay and spending pattern — flagged by an "
    "isolation forest fitted over every work, not by any single figure being out of range"
)


def cost_reason(p: Params) -> Column:
    """Stated only where the comparison can be shown: an amount, a median and enough peers."""
    peers = F.col("peer_count")
    basis = (
        F.col("peer_median_cost").isNotNull()
        & F.col("sanctioned_amount").isNotNull()
        & (peers.isNull() | (peers >= p.min_peers))
    )
    sentence = F.concat(
        F.lit(RUPEE), grouped("sanctioned_amount"), F.lit(f" against a {RUPEE}"),
        grouped("peer_median_cost"), F.lit(" median for "),
        F.coalesce(F.col("sector"), F.lit("similar")), F.lit(" works in "), F.col("district"),
        F.lit(" ("), whole("cost_deviation_pct"), F.lit("% above"),
        F.coalesce(F.concat(F.lit(", "), peers.cast("string"), F.lit(" peer works")), F.lit("")),
        F.lit(")"),
    )
    return (
        F.when((F.col("cost_deviation_pct") > p.reason_above) & basis, sentence)
        .when(F.col("iso_anomaly") > p.reason_above, F.lit(FOREST_REASON))
    )


def agency_reason(p: Params) -> Column:
    """Names the one signal responsible; ties go delay, concentration, pending."""
    delay = _delay_signal("agency_delay_rate")
    concentration = F.coalesce(F.col("agency_concentration_risk"), F.lit(0.0))
    pending = pending_risk("agency_oldest_pending_days", p)
    driver = F.greatest(delay, concentration, pending)
    delayed = F.concat(
        F.lit("Implementing agency has a "), whole(delay),
        F.lit("% delay rate across its projects"),
    )
    named = (
        F.when(driver == delay, delayed)
        .when(driver == concentration, concentration_reason("agency_"))
        .otherwise(pending_reason(p, "agency_"))
    )
    return F.when(F.col("agency_risk") > p.reason_above, named)


def flag_reasons(p: Params) -> Column:
    """Ordered sentences: compliance, cost or forest, delay, duplicate, agency."""
    late = F.concat(F.col("delay_days").cast("string"), F.lit(" days beyond expected completion"))
    alike = F.concat(
        whole(F.col("max_similarity_score") * 100), F.lit("% similarity with another nearby work")
    )
    return F.array_compact(
        F.concat(
            F.col("compliance_reasons"),
            F.array(
                cost_reason(p),
                F.when(F.col("delay_risk") > p.reason_above, late),
                F.when(F.col("duplicate_risk") > p.reason_above, alike),
                agency_reason(p),
            ),
        )
    )


def method_for(reason) -> Column:
    """Which method a reason sentence came from."""
    text = F.lower(col(reason))
    return (
        F.when(text.contains("isolation forest"), "Isolation forest")
        .when(text.contains("similarity"), "Text similarity")
        .when(text.contains("median"), "Peer comparison")
        .when(text.contains("vendor"), "Herfindahl-Hirschman index")
        .when(text.contains("beyond expected completion"), "Published dates")
        .when(text.contains("still in progress"), "Payment records")
        .when(text.contains("delay rate"), "Published dates")
        .otherwise("Stated compliance rule")
    )


def contributions(p: Params) -> Column:
    """Components contributing at least one point, largest first."""
    parts = [
        ("cost", p.weight_cost), ("delay", p.weight_delay), ("duplicate", p.weight_duplicate),
        ("agency", p.weight_agency), ("compliance", p.weight_compliance),
    ]
    entries = F.array(*[
        F.struct(
            (-rounded(F.coalesce(F.col(f"{name}_risk"), F.lit(0.0)) * weight, 4)).alias("neg"),
            F.lit(i).alias("place"), F.lit(name).alias("component"),
        )
        for i, (name, weight) in enumerate(parts)
    ])
    ranked = F.array_sort(F.filter(entries, lambda e: e["neg"] <= -1.0))
    return F.transform(
        ranked, lambda e: F.struct(e["component"].alias("component"), (-e["neg"]).alias("points"))
    )
