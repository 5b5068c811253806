"""Works to scores over peers, agencies, similarity and rules; statistics are cut on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import forest, peers, vendors
from ..params import Params
from ..session import cut, cut_by

SCORE_COLUMNS = [
    "work_key", "delay_days", "cost_deviation_pct", "expenditure_ratio", "sector",
    "peer_median_cost", "peer_count", "agency_delay_rate", "max_similarity_score",
    "similar_work_key", "cost_risk", "delay_risk", "duplicate_risk", "agency_risk",
    "compliance_risk", "overall_risk_score", "risk_level", "flagged_reasons",
]

#: Up to so many agencies and terms their figures are broadcast to the works.
FEW_AGENCIES = 200_000

FOREST_FEATURES = ["sanctioned_amount", "delay_days", "expenditure_ratio"]


def timed(works: DataFrame, p: Params) -> DataFrame:
    return works.withColumns({
        "delay_days": risk.delay_days("expected_completion", "actual_completion", p.as_of),
        "expenditure_ratio": risk.expenditure_ratio("expenditure", "sanctioned_amount"),
    })


def attach_agencies(
    works: DataFrame, rates: DataFrame, profile: DataFrame | None,
    beside: tuple[str, ...] = (), parts: int | None = None, few: int = FEW_AGENCIES,
) -> DataFrame:
    """Left join of an agency's delay rate and of its profile in the work's term.

    ``beside`` names columns that go with the work's key, never NULL, and by which the works are
    dealt to ``parts`` parts. A few agencies are broadcast then. Of more, each part asks for those
    that it meets, and is sent their figures: no whole row moves to its agency and back.
    """
    def joined(rows: DataFrame, found=lambda df: df) -> DataFrame:
        return vendors.attach_profile(
            rows.join(found(rates), "implementing_agency", "left"),
            None if profile is None else found(profile))

    if not beside:
        return joined(works)
    if all(df is None or df.count() <= few for df in (rates, profile)):
        return joined(works, F.broadcast)
    term = F.coalesce(F.col("ls_term").cast("int"), F.lit(0)) if "ls_term" in works.columns \
        else F.lit(0)
    asked = works.filter(F.col("implementing_agency").isNotNull()).select(
        *beside, "implementing_agency", term.alias("ls_term")).distinct()
    found = joined(asked)
    if parts:
        found = found.repartition(parts, *beside)
    found = found.withColumnsRenamed({"implementing_agency": "__agency", "ls_term": "__term"})
    on = (F.col("implementing_agency") == F.col("__agency")) & (F.col("__wt") == F.col("__term"))
    rows = works.withColumn("__wt", term)
    for c in beside:
        found = found.withColumnRenamed(c, f"__{c}")
        on = on & (F.col(c) == F.col(f"__{c}"))
    return rows.join(found, on, "left").drop(
        "__agency", "__term", "__wt", *[f"__{c}" for c in beside])


def with_anomaly(frame: DataFrame, by_key: int | None = None) -> DataFrame:
    """Isolation-forest anomaly, 0-100 over all works, which may lie by key in ``by_key`` parts.

    Scored works are cut to the shared folder once: the min-max bounds, the peer and agency
    statistics and the final join all read them, and none should score them again.
    """
    model = forest.iforest_fit(frame, FOREST_FEATURES, "work_key")
    scored = frame.withColumn("iso_raw", forest.iforest_score(model))
    scored = cut_by(scored, "anomaly", "work_key", by_key) if by_key else cut(scored, "anomaly")
    return forest.min_max(scored, "iso_raw", "iso_anomaly").drop("iso_raw")


def attach_similarity(works: DataFrame, similarity: DataFrame | None) -> DataFrame:
    if similarity is None:
        return works.withColumns({
            "max_similarity_score": F.lit(0.0),
            "similar_work_key": F.lit(None).cast("string")})
    # Columns of the work beside its key belong to the key: rows dealt by them are not moved.
    joined = works.join(similarity, [c for c in similarity.columns if c in works.columns], "left")
    return joined.withColumn("max_similarity_score",
                             F.coalesce("max_similarity_score", F.lit(0.0)))


def score_works(
    works: DataFrame, payments: DataFrame | None, p: Params,
    similarity: DataFrame | None = None, use_forest: bool = True, keep_works: bool = False,
    beside: tuple[str, ...] = (), parts: int | None = None, by_key: int | None = None,
) -> DataFrame:
    """Scores per work; with ``keep_works`` the work's own columns stay beside them, else those
    named in ``beside``, which go with the work's key and by which works may lie in ``parts`` parts.

    ``similarity`` has work_key, similar_work_key and max_similarity_score (see
    ``operators.similarity.nearest_peer``), and may have columns that go with the work's key. ``use_forest`` blends the isolation forest into
    the cost component; works that lie by key in ``by_key`` parts stay there. Peers, rates, profiles and the forest are cut while the plan is built.
    """
    # Rows without a key cannot be scored: a score is keyed on it.
    keyed = works.filter(F.col("work_key").isNotNull())
    frame = timed(keyed, p)
    if use_forest:
        frame = with_anomaly(frame, by_key)
    else:
        frame = frame.withColumn("iso_anomaly", F.lit(0.0))
    profile = None if payments is None else cut(vendors.vendor_profile(payments, p), "profile")
    rates = cut(peers.agency_delay_rate(frame, p.late_days), "delay-rates")
    frame = peers.peer_baseline(frame, min_peers=p.min_peers)
    frame = attach_agencies(frame, rates, profile, beside, parts)
    frame = attach_similarity(frame, similarity)
    frame = frame.withColumns({
        "cost_risk": F.greatest(
            risk.cost_risk("cost_deviation_pct", "peer_count", p.min_peers),
            F.col("iso_anomaly")),
        "delay_risk": risk.delay_risk("delay_days", p.delay_full_days),
        "duplicate_risk": risk.duplicate_risk("max_similarity_score", p.similarity_floor),
        "agency_risk": risk.agency_risk("agency_delay_rate", "agency_concentration_risk",
                                        "agency_oldest_pending_days", p),
        "compliance_risk": risk.compliance_risk(),
        "compliance_reasons": risk.compliance_reasons(),
    })
    frame = frame.withColumn("overall_risk_score", risk.overall_score(p))
    frame = frame.withColumns({
        "risk_level": risk.risk_level("overall_risk_score", p.medium_from, p.high_from),
        "flagged_reasons": risk.flag_reasons(p),
    })
    if keep_works:
        own = [c for c in works.columns if c not in SCORE_COLUMNS]
        return frame.select(*SCORE_COLUMNS, *own)
    return frame.select(*SCORE_COLUMNS, *beside)


def scored_view(works: DataFrame, scores: DataFrame, parts: int | None = None) -> DataFrame:
    """Works, left-joined to their scores and to the work they resemble.

    A work loaded but not yet scored still appears, with NULLs and no reasons. Columns of the
    work that ``scores`` has beside the scores go with its key; where both tables are dealt by
    such a column to ``parts`` parts, no whole row moves, only the keys asked for do.
    """
    own = [c for c in works.columns if c != "sector"]
    near = [c for c in scores.columns if c in own and c not in SCORE_COLUMNS]
    joined = works.select(*own).join(scores, ["work_key", *near], "left")
    asked = scores.filter(F.col("similar_work_key").isNotNull()).select(
        *near, F.col("similar_work_key").alias("__asked")).distinct()
    found = asked.join(works.select(F.col("work_key").alias("__asked")), "__asked", "left_semi")
    if parts and near:
        found = found.repartition(parts, *near)
    found = found.withColumn("similar_found", F.col("__asked"))
    # A work without a peer asks for a key of its own that nobody has, so they do not all meet.
    own_key = F.coalesce("similar_work_key", F.concat(F.lit("\u0000"), F.col("work_key")))
    return joined.withColumn("__asked", own_key).join(found, [*near, "__asked"], "left").select(
        "work_key",
        F.substring("description", 1, 60).alias("work_name"),
        *[c for c in own if c != "work_key"],
        *[c for c in SCORE_COLUMNS
          if c not in ("work_key", "similar_work_key", "flagged_reasons")],
        F.col("similar_found").alias("similar_work_key"),
        F.coalesce("flagged_reasons", F.array().cast("array<string>")).alias("flagged_reasons"),
    )
