"""Peer baselines, profiles, component scores, the flagship and the detectors."""

from pyspark.sql import functions as F

from ..functions import numeric, risk
from ..operators import detectors, peers, quantiles, vendors
from ..plans import scoring
from ..session import cut, joined_in_place
from ..sources import fixtures
from .base_sql import r, ramp
from .registry import query

SCORE_SQL = """SELECT work_key, delay_days, cost_deviation_pct, expenditure_ratio, sector,
  peer_median_cost, peer_count, agency_delay_rate, max_similarity_score, similar_work_key,
  cost_risk::DOUBLE AS cost_risk, delay_risk, duplicate_risk, agency_risk, compliance_risk,
  overall_risk_score, risk_level, array_to_string(flagged_reasons, ' | ') AS flagged_reasons
FROM scored"""


@query("score_works", "E2-E13 A2 A3 A5 J2 P27", SCORE_SQL)
def score_works(t):
    scores = scoring.score_works(t.works, t.payments, t.p, t.similarity, use_forest=False)
    # Written here: works and similarities lie by order and are joined without being moved.
    with joined_in_place(t.spark):
        return cut(scores, "score-works")


@query("scored_view", "S10 J1", """SELECT s.work_key, s.work_name, s.state, s.district,
  s.sanctioned_amount::DOUBLE AS sanctioned_amount, s.overall_risk_score, s.risk_level,
  o.work_key AS similar_work_key, len(s.flagged_reasons) AS reasons
FROM scored s LEFT JOIN works o ON o.work_key = s.similar_work_key""")
def scored_view(t):
    return scoring.scored_view(t.works, t.scores).select(
        "work_key", "work_name", "state", "district", "sanctioned_amount", "overall_risk_score",
        "risk_level", "similar_work_key", F.size("flagged_reasons").cast("bigint").alias("reasons"))


@query("scored_view_unscored", "S10 A36", """SELECT work_key, left(description, 60) AS work_name,
  CASE WHEN ls_term = 18 THEN overall_risk_score END AS overall_risk_score,
  CASE WHEN ls_term = 18 THEN len(flagged_reasons) ELSE 0 END AS reasons FROM scored""")
def scored_view_unscored(t):
    scored_18 = t.works.filter("ls_term = 18").select("work_key")
    partial = t.scores.join(scored_18, "work_key", "left_semi")
    return scoring.scored_view(t.works, partial).select(
        "work_key", "work_name", "overall_risk_score",
        F.size("flagged_reasons").cast("bigint").alias("reasons"))


@query("peer_baseline", "A2 W1 E4", """SELECT work_key, peer_median_cost, peer_count,
  cost_deviation_pct, cost_risk::DOUBLE AS cost_risk FROM scored""")
def peer_baseline(t):
    base = peers.peer_baseline(t.works)
    return base.select("work_key", "peer_median_cost", "peer_count", "cost_deviation_pct",
                       risk.cost_risk("cost_deviation_pct", "peer_count").alias("cost_risk"))


@query("peer_guard", "A2 E4 E22", """SELECT work_key, peer_count >= 400 AS compared,
  CASE WHEN peer_count < 400 THEN 0.0 ELSE cost_deviation_pct END::DOUBLE AS cost_deviation_pct
FROM scored""")
def peer_guard(t):
    base = peers.peer_baseline(t.works, min_peers=400)
    return base.select("work_key", risk.has_peers("peer_count", 400).alias("compared"),
                       "cost_deviation_pct")


@query("peer_stats", "A2 W1", """SELECT district, sector, peer_count, peer_median_cost
FROM peer""")
def peer_stats(t):
    return peers.peer_stats(t.works)


@query("top_deviations", "A2 K3", """SELECT work_key, cost_deviation_pct, peer_median_cost
FROM scored ORDER BY cost_deviation_pct DESC, work_key LIMIT 20""")
def top_deviations(t):
    return peers.peer_baseline(t.works).orderBy(
        F.col("cost_deviation_pct").desc(), "work_key").limit(20).select(
        "work_key", "cost_deviation_pct", "peer_median_cost")


@query("agency_delay_rate", "A3 W2 E2", "SELECT * FROM agency_rate")
def agency_delay_rate(t):
    return peers.agency_delay_rate(scoring.timed(t.works, t.p), t.p.late_days)


@query("delay_and_ratio", "E2 E3 E5", """SELECT work_key, delay_days, expenditure_ratio,
  delay_risk FROM scored""")
def delay_and_ratio(t):
    return scoring.timed(t.works, t.p).select(
        "work_key", "delay_days", "expenditure_ratio",
        risk.delay_risk("delay_days").alias("delay_risk"))


@query("duplicate_risk", "E6 E22", """SELECT work_key, duplicate_risk,
  max_similarity_score >= 0.94 AS near_duplicate FROM scored""")
def duplicate_risk(t):
    return fixtures.similarity(t.works).select(
        "work_key", risk.duplicate_risk("max_similarity_score").alias("duplicate_risk"),
        risk.near_duplicate("max_similarity_score").alias("near_duplicate"))


@query("vendor_profile", "A5 E7 E8", "SELECT * FROM profile")
def vendor_profile(t):
    return vendors.vendor_profile(t.payments, t.p)


@query("vendor_hhi", "A4", f"""SELECT implementing_agency, {r("hhi", 4)} AS hhi FROM (
  SELECT implementing_agency, sum(s * s) / (sum(s) * sum(s)) AS hhi FROM (
    SELECT implementing_agency, vendor, sum(expenditure_amount)::DOUBLE AS s
    FROM payments GROUP BY 1, 2) GROUP BY 1)""")
def vendor_hhi(t):
    return vendors.hhi(t.payments, ["implementing_agency"], "vendor", "expenditure_amount")


@query("pending_risk", "E1 E8", f"""SELECT implementing_agency, ls_term,
  {r(ramp("oldest_pending_days", 90, 730), 2)} AS pending_risk FROM profile""")
def pending_risk(t):
    return t.profile.select("implementing_agency", "ls_term",
                            risk.pending_risk("oldest_pending_days", t.p).alias("pending_risk"))


@query("agency_reasons", "E14", """SELECT implementing_agency, ls_term,
  CASE WHEN concentration_risk > 0 THEN round(top_vendor_share_pct::DECIMAL(24,8), 0)::BIGINT
    || '% of this agency''s ₹' || format('{:,}', round(total_spend::DECIMAL(24,8), 0)::BIGINT)
    || ' spend went to one vendor (' || top_vendor || '), across ' || vendor_count || ' vendors and '
    || transaction_count || ' transactions' END AS concentration,
  CASE WHEN oldest_pending_days > 90 THEN pending_count || CASE WHEN pending_count = 1
    THEN ' payment' ELSE ' payments' END || ' still in progress, oldest ' || oldest_pending_days
    || ' days' END AS pending FROM profile""")
def agency_reasons(t):
    return t.profile.select("implementing_agency", "ls_term",
                            risk.concentration_reason().alias("concentration"),
                            risk.pending_reason(t.p).alias("pending"))


@query("compliance_risk", "E10", """SELECT work_key, compliance_risk,
  array_to_string(list_filter(flagged_reasons, lambda x: x IN ('Expenditure exceeds sanctioned amount',
    'Missing start or expected completion date', 'Marked completed with no actual completion date',
    'Completed work has no photographic documentation on record')), ' | ') AS compliance_reasons
FROM scored""")
def compliance_risk(t):
    return t.works.select("work_key", risk.compliance_risk().alias("compliance_risk"),
                          risk.compliance_reasons().alias("compliance_reasons"))


DIRTY_COMPLIANCE = """dirty AS (SELECT work_key, work_status, expenditure, sanctioned_amount,
  CASE WHEN order_id % 7 = 0 THEN NULL ELSE start_date END AS start_date,
  CASE WHEN order_id % 5 = 0 THEN NULL ELSE expected_completion END AS expected_completion,
  actual_completion, has_images FROM works)"""


@query("compliance_missing_dates", "E10 P7", """SELECT work_key,
  least(CASE WHEN expenditure > sanctioned_amount THEN 60.0 ELSE 0.0 END
   + CASE WHEN work_status = 'recommended' AND (start_date IS NULL OR expected_completion IS NULL)
     THEN 20.0 ELSE 0.0 END
   + CASE WHEN work_status = 'completed' AND actual_completion IS NULL THEN 20.0 ELSE 0.0 END
   + CASE WHEN work_status = 'completed' AND has_images IS FALSE THEN 30.0 ELSE 0.0 END, 100.0)
  ::DOUBLE AS compliance_risk,
  greatest(coalesce(date_diff('day', expected_completion, coalesce(actual_completion,
    DATE '2001-08-01')), 0), 0)::INTEGER AS delay_days FROM dirty""", extra=DIRTY_COMPLIANCE)
def compliance_missing_dates(t):
    dirty = t.works.withColumns({
        "start_date": F.when(F.col("order_id") % 7 != 0, F.col("start_date")),
        "expected_completion": F.when(F.col("order_id") % 5 != 0, F.col("expected_completion"))})
    return dirty.select(
        "work_key", risk.compliance_risk().alias("compliance_risk"),
        risk.delay_days("expected_completion", "actual_completion", t.p.as_of).alias("delay_days"))


@query("reason_methods", "E17", """SELECT method, count(*) AS reasons FROM (
  SELECT CASE WHEN contains(x, 'similarity') THEN 'Text similarity'
    WHEN contains(x, 'median') THEN 'Peer comparison'
    WHEN contains(x, 'vendor') THEN 'Herfindahl-Hirschman index'
    WHEN contains(x, 'beyond expected completion') THEN 'Published dates'
    WHEN contains(x, 'still in progress') THEN 'Payment records'
    WHEN contains(x, 'delay rate') THEN 'Published dates'
    ELSE 'Stated compliance rule' END AS method
  FROM (SELECT lower(unnest(flagged_reasons)) AS x FROM scored)) GROUP BY 1""")
def reason_methods(t):
    return t.scored.select(F.explode("flagged_reasons").alias("reason")).groupBy(
        risk.method_for("reason").alias("method")).agg(F.count(F.lit(1)).alias("reasons"))


_POINTS = ", ".join(
    f"({i}, '{c}', {r(f'{c}_risk * {w}::DOUBLE', 4)})" for i, (c, w) in enumerate(
        [("cost", 0.25), ("delay", 0.25), ("duplicate", 0.2), ("agency", 0.15),
         ("compliance", 0.15)]))


@query("risk_contributions", "E18", f"""SELECT work_key, string_agg(component, ', '
  ORDER BY points DESC, place) FILTER (points >= 1) AS drivers,
  coalesce(max(points) FILTER (points >= 1), 0.0) AS top_points
FROM (SELECT s.work_key, v.place, v.component, v.points FROM scored s,
      LATERAL (VALUES {_POINTS}) v(place, component, points)) GROUP BY work_key""")
def risk_contributions(t):
    parts = t.scored.select("work_key", risk.contributions(t.p).alias("parts"))
    names = F.array_join(F.transform("parts", lambda e: e["component"]), ", ")
    return parts.select(
        "work_key", F.nullif(names, F.lit("")).alias("drivers"),
        F.coalesce(F.try_element_at("parts", F.lit(1))["points"], F.lit(0.0)).alias("top_points"))


@query("risk_bands", "E11 E12", """SELECT risk_level, count(*) AS works,
  min(overall_risk_score) AS lowest, max(overall_risk_score) AS highest FROM scored GROUP BY 1""")
def risk_bands(t):
    return t.scored.groupBy(risk.risk_level("overall_risk_score").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("works"), F.min("overall_risk_score").alias("lowest"),
        F.max("overall_risk_score").alias("highest"))


@query("fiscal_years", "E15", """SELECT fy, count(*) AS payments FROM (
  SELECT CASE WHEN month(expenditure_date) >= 4 THEN year(expenditure_date)
    ELSE year(expenditure_date) - 1 END AS y, y || '-' || CASE WHEN y % 100 = 99 THEN '100'
    ELSE lpad((y % 100 + 1)::VARCHAR, 2, '0') END AS fy FROM payments) GROUP BY 1""")
def fiscal_years(t):
    return t.payments.groupBy(numeric.fiscal_year("expenditure_date").alias("fy")).agg(
        F.count(F.lit(1)).alias("payments"))


@query("first_digits", "E16", """SELECT digit, count(*) AS payments FROM digits GROUP BY 1""")
def first_digits(t):
    digit = numeric.first_digit("expenditure_amount")
    return t.payments.filter(digit.isNotNull()).groupBy(digit.alias("digit")).agg(
        F.count(F.lit(1)).alias("payments"))


@query("calibration", "F4", "SELECT count(*) AS n, "
       + ", ".join(f"{r(f'quantile_cont(overall_risk_score, {q / 100})', 4)} AS p{q:02d}"
                   for q in (25, 50, 75, 90, 95, 99)) + " FROM scored")
def calibration(t):
    return quantiles.calibrate(t.scored, "overall_risk_score")


@query("calibration_by_state", "F4", f"""SELECT state, count(*) AS n,
  {r("quantile_cont(sanctioned_amount::DOUBLE, 0.1)", 4)} AS p10,
  {r("quantile_cont(sanctioned_amount::DOUBLE, 0.9)", 4)} AS p90 FROM works GROUP BY 1""")
def calibration_by_state(t):
    q = quantiles.exact_percentiles(t.works, ["state"], "sanctioned_amount",
                                    {"p10": 0.1, "p90": 0.9})
    return q.select("state", "n", *[numeric.rounded(c, 4).alias(c) for c in ("p10", "p90")])


# ------------------------------------------------------------------ detectors


@query("year_end_burst", "A6", f"""SELECT implementing_agency AS subject, ls_term, fy AS period,
  {r("sev", 2)} AS severity, payments, march_payments, {r("share", 1)} AS march_share_pct,
  march_amount, total_amount, headline FROM d01
JOIN findings f ON f.code = 'D-01' AND f.subject = implementing_agency AND f.ls_term = d01.ls_term
  AND f.period = fy""".replace("ls_term, fy", "d01.ls_term, fy"))
def year_end_burst(t):
    return detectors.year_end_burst(t.payments, t.p, measures=True).select(
        "subject", "ls_term", "period", "severity", "payments", "march_payments",
        "march_share_pct", "march_amount", "total_amount", "headline")


@query("first_digit_anomaly", "A7", f"""SELECT implementing_agency AS subject, d02.ls_term,
  {r("sev", 2)} AS severity, payments, mad, worst_digit, headline FROM d02
JOIN findings f ON f.code = 'D-02' AND f.subject = implementing_agency
  AND f.ls_term = d02.ls_term""")
def first_digit_anomaly(t):
    return detectors.first_digit_anomaly(t.payments, t.p, measures=True).select(
        "subject", "ls_term", "severity", "payments", "mad", "worst_digit", "headline")


@query("idle_allocation", "A9 W3", f"""SELECT mp_id AS subject, d03.ls_term, {r("sev", 2)}
  AS severity, {r("allocated_amount::DOUBLE - amount_recommended::DOUBLE", 2)} AS idle_amount,
  {r("share", 1)} AS idle_share_pct, recommended_works, headline FROM d03
JOIN findings f ON f.code = 'D-03' AND f.subject = mp_id AND f.ls_term = d03.ls_term""")
def idle_allocation(t):
    return detectors.idle_allocation(t.members, t.p, measures=True).select(
        "subject", "ls_term", "severity", "idle_amount", "idle_share_pct", "recommended_works",
        "headline")


UNIFORM = f"""rounded_works AS (
  SELECT implementing_agency, ls_term,
    (round(sanctioned_amount::DOUBLE / 10000) * 10000)::DOUBLE AS amount FROM works
), amount_counts AS (
  SELECT implementing_agency, ls_term, amount, count(*) AS n FROM rounded_works GROUP BY 1, 2, 3
), d04 AS (
  SELECT implementing_agency, ls_term, sum(n)::BIGINT AS works, max(n) AS works_at_amount,
    count(*) AS distinct_amounts FROM amount_counts GROUP BY 1, 2 HAVING sum(n) >= 25
), d04_top AS (
  SELECT d04.*, amount, works_at_amount::DOUBLE / works * 100 AS share,
    {ramp("(works_at_amount::DOUBLE / works * 100)", 12.5, 15.2)} AS sev
  FROM d04 JOIN (SELECT * FROM amount_counts QUALIFY row_number() OVER (PARTITION BY
    implementing_agency, ls_term ORDER BY n DESC, amount) = 1) USING (implementing_agency, ls_term)
)"""


def _rounded_works(t):
    return t.works.withColumn(
        "sanctioned_amount", F.round(F.col("sanctioned_amount").cast("double") / 10000) * 10000)


@query("uniform_amount", "A10", f"""SELECT implementing_agency AS subject, ls_term,
  {r("sev", 2)} AS severity, works, amount, works_at_amount, {r("share", 1)} AS share_pct,
  distinct_amounts, round(share::DECIMAL(24,8), 0)::BIGINT || '% of this agency''s ' || works
    || ' works were sanctioned at exactly Rs ' || format('{{:,}}', amount::BIGINT) AS headline
FROM d04_top WHERE sev > 0""", extra=UNIFORM)
def uniform_amount(t):
    return detectors.uniform_amount(_rounded_works(t), t.p, measures=True).select(
        "subject", "ls_term", "severity", "works", "amount", "works_at_amount", "share_pct",
        "distinct_amounts", "headline")


@query("all_findings", "A11 U2", "SELECT * FROM findings")
def all_findings(t):
    return detectors.run_detectors(t.works, t.payments, t.members, t.p).drop("evidence")


@query("detector_silence", "A11", """SELECT code, detector_name FROM catalogue
WHERE code NOT IN (SELECT code FROM findings)""")
def detector_silence(t):
    return detectors.detector_silence(t.findings)


@query("detector_catalogue", "A21 J17", """SELECT code, detector_name, subject_kind,
  count(severity) AS findings, max(severity) AS max_severity
FROM catalogue LEFT JOIN findings USING (code) GROUP BY 1, 2, 3""")
def detector_catalogue(t):
    return detectors.findings_by_code(t.findings)


@query("findings_with_limits", "J17", """SELECT code, subject, ls_term, period, severity,
  detector_name FROM findings JOIN catalogue USING (code)""")
def findings_with_limits(t):
    return detectors.with_limits(t.findings).select(
        "code", "subject", "ls_term", "period", "severity", "detector_name")
