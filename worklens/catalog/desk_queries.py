"""Headlines, rankings, trends, forecast, compliance and the three desks."""

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.text import state_key
from ..operators.quantiles import exact_percentiles
from ..plans import desks, queue
from .base_sql import AS_OF, r
from .registry import query

STATE, DISTRICT, MEMBER = "ASIA", "NATION_2", "7"
HERE = f"state = '{STATE}' AND ls_term = 18"
THERE = f"state = '{STATE}' AND district = '{DISTRICT}' AND ls_term = 18"
IN_QUEUE = "count(*) FILTER (overall_risk_score >= 40)"
HIGH = "count(*) FILTER (risk_level = 'HIGH')"
SANCTIONED = "coalesce(sum(sanctioned_amount), 0)::DOUBLE"
FLAGGED = "coalesce(sum(sanctioned_amount) FILTER (overall_risk_score >= 40), 0)::DOUBLE"
MEAN = "(sum(overall_risk_score::DECIMAL(24,8))::DOUBLE / count(overall_risk_score))"


def rate(num: str, den: str, digits: int = 1) -> str:
    return f"CASE WHEN {den} > 0 THEN {r(f'({num})::DOUBLE / ({den})::DOUBLE * 100', digits)} END"


def overview_sql(where: str) -> str:
    return f"""SELECT * FROM (SELECT count(*) AS total_projects,
    count(*) FILTER (work_status = 'completed') AS completed_count,
    count(*) FILTER (work_status = 'recommended') AS pending_count,
    coalesce(sum(expenditure), 0)::DOUBLE AS total_expenditure,
    coalesce(sum(expenditure) FILTER (work_status = 'completed'), 0)::DOUBLE
      AS completed_works_value,
    {SANCTIONED} AS sanctioned_total, {HIGH} AS high_risk_count,
    count(*) FILTER (delay_days > 60) AS delayed_count, {IN_QUEUE} AS anomaly_count
  FROM scored {where}), (SELECT coalesce(sum(expenditure_amount), 0)::DOUBLE AS vendor_payments,
    count(*) AS payment_count FROM payments {where}),
  (SELECT coalesce(sum(allocated_amount), 0)::DOUBLE AS allocated_total,
    count(DISTINCT mp_id) AS mp_count FROM members {where})"""


@query("overview", "A1", overview_sql(""))
def overview(t):
    return desks.overview(t.scored, t.payments, t.members)


@query("overview_term", "A1", overview_sql("WHERE ls_term = 18"))
def overview_term(t):
    return desks.overview(t.scored, t.payments, t.members, 18)


@query("scoring_pending", "A36", """SELECT count(*) > 0 AND count(*) FILTER (risk_level = 'HIGH') = 0
  AND count(*) FILTER (delay_days > 60) = 0 AND count(*) FILTER (overall_risk_score >= 40) = 0
  AS scoring_pending FROM scored""")
def scoring_pending(t):
    return desks.scoring_pending(desks.overview(t.scored, t.payments, t.members))


@query("states_pending", "A36", f"""SELECT bool_and(a = 0 AND h = 0) AS scoring_pending FROM (
  SELECT state, {MEAN} AS a, {HIGH} AS h FROM scored GROUP BY 1)""")
def states_pending(t):
    return desks.aggregate_pending(desks.state_map(t.scored), "avg_risk_score", "high_risk_count")


@query("filter_states", "A12", "SELECT state, count(*) AS works FROM works GROUP BY 1")
def filter_states(t):
    return desks.filter_states(t.works)


@query("filter_bands", "A12", "SELECT DISTINCT risk_level FROM scored")
def filter_bands(t):
    return desks.filter_bands(t.scored)


STATE_MAP = f"""SELECT state, count(*) AS total_projects, {HIGH} AS high_risk_count,
  {IN_QUEUE} AS flagged_count, {r(MEAN, 4)} AS avg_risk_score,
  {rate(IN_QUEUE, "count(*)")} AS flagged_share FROM scored GROUP BY 1"""


@query("state_map", "A14", STATE_MAP)
def state_map(t):
    return desks.state_map(t.scored)


@query("state_map_bins", "E19 A14", f"""SELECT state, CASE WHEN flagged_share < 5 THEN 0
  WHEN flagged_share < 15 THEN 1 WHEN flagged_share < 25 THEN 2 WHEN flagged_share < 35 THEN 3
  ELSE 4 END AS bin FROM ({STATE_MAP})""")
def state_map_bins(t):
    return desks.state_map(t.scored).select("state", numeric.share_bin("flagged_share").alias("bin"))


@query("state_map_boundaries", "J15 P20", f"""SELECT b.boundary, m.state,
  m.total_projects::DOUBLE AS total_projects FROM (SELECT CASE r_name WHEN 'ASIA' THEN 'The ' || r_name || ' & Islands'
    WHEN 'EUROPE' THEN lower(r_name) || '  islands' ELSE 'the ' || r_name END AS boundary,
    r_name FROM region) b
LEFT JOIN ({STATE_MAP}) m ON m.state = b.r_name AND b.r_name <> 'ASIA'
ORDER BY 1""")
def state_map_boundaries(t):
    name = F.col("r_name")
    boundary = (
        F.when(name == "ASIA", F.concat(F.lit("The "), name, F.lit(" & Islands")))
        .when(name == "EUROPE", F.concat(F.lower(name), F.lit("  islands")))
        .otherwise(F.concat(F.lit("the "), name)))
    found = t.raw("region").select(boundary.alias("boundary"))
    return desks.state_map_on(found, t.scored).select(
        "boundary", "state", F.col("total_projects").cast("double").alias("total_projects"))


@query("agency_ranking", "A15 J4", f"""SELECT implementing_agency, ls_term, total_projects,
  delayed_count, anomaly_count, avg_risk_score, vendor_count, transaction_count, total_spend,
  top_vendor, top_vendor_share_pct, coalesce(concentration_risk, 0.0) AS concentration_risk
FROM (SELECT implementing_agency, ls_term, count(*) AS total_projects,
    count(*) FILTER (delay_days > 60) AS delayed_count, {HIGH} AS anomaly_count,
    {r(MEAN, 4)} AS avg_risk_score FROM scored GROUP BY 1, 2 HAVING count(*) >= 10)
LEFT JOIN profile USING (implementing_agency, ls_term)
ORDER BY avg_risk_score DESC, total_projects DESC, implementing_agency, ls_term LIMIT 100""")
def agency_ranking(t):
    return desks.agency_ranking(t.scored, t.profile, t.p)


@query("member_balances", "A16 J5", f"""SELECT mp_id, ls_term, mp_name, constituency, state, house,
  allocated_amount::DOUBLE AS allocated_amount, amount_recommended::DOUBLE AS amount_recommended,
  total_expenditure::DOUBLE AS total_expenditure, utilization_pct,
  unspent_amount::DOUBLE AS unspent_amount, completion_rate_pct, pending_payments,
  (allocated_amount - amount_recommended)::DOUBLE AS idle_amount,
  coalesce(total_projects, 0) AS total_projects, coalesce(high_risk_works, 0) AS high_risk_works
FROM members LEFT JOIN (SELECT mp_id, ls_term, count(*) AS total_projects,
  {HIGH} AS high_risk_works FROM scored GROUP BY 1, 2) USING (mp_id, ls_term)
WHERE allocated_amount > 0 ORDER BY idle_amount DESC NULLS LAST, mp_id, ls_term LIMIT 100""")
def member_balances(t):
    return desks.member_balances(t.members, t.scored)


DIRECTORY = f"""SELECT m.*, (allocated_amount - amount_recommended) AS idle_amount,
  coalesce(total_projects, 0) AS total_projects,
  coalesce(completed_projects, 0) AS completed_projects,
  coalesce(high_risk_works, 0) AS high_risk_works, coalesce(in_queue, 0) AS in_queue,
  coalesce(districts, 0) AS districts
FROM members m LEFT JOIN (SELECT mp_id, count(*) AS total_projects,
  count(*) FILTER (work_status = 'completed') AS completed_projects, {HIGH} AS high_risk_works,
  {IN_QUEUE} AS in_queue, count(DISTINCT district) AS districts
  FROM scored WHERE ls_term = 18 GROUP BY 1) USING (mp_id) WHERE ls_term = 18"""


@query("member_directory", "A17 J5", f"""SELECT mp_id, ls_term, mp_name, constituency, state, house,
  allocated_amount::DOUBLE AS allocated_amount, idle_amount::DOUBLE AS idle_amount,
  unspent_amount::DOUBLE AS unspent_amount, completed_works, recommended_works,
  transaction_count, pending_payments, total_projects, completed_projects, high_risk_works,
  in_queue, districts FROM ({DIRECTORY})""")
def member_directory(t):
    return desks.member_directory(t.members, t.scored, 18).drop(
        "amount_recommended", "total_expenditure", "completion_rate_pct")


CARDS = f"""cards AS (SELECT mp_id AS id, ls_term AS term, mp_name AS name,
  house, CASE WHEN house <> 'Rajya Sabha' THEN constituency
    WHEN contains(lower(constituency), 'nominated') THEN 'Nominated' END AS seat, state,
  allocated_amount::DOUBLE AS allocated, amount_recommended::DOUBLE AS committed,
  total_expenditure::DOUBLE AS paid, idle_amount::DOUBLE AS idle,
  {rate("amount_recommended", "allocated_amount", 4)} AS committed_rate,
  {rate("total_expenditure", "allocated_amount", 4)} AS paid_rate,
  total_projects AS works, in_queue, high_risk_works AS high_risk,
  'Party ' || (mp_id::INTEGER % 7) AS party, 'P' || (mp_id::INTEGER % 7) AS party_short
  FROM ({DIRECTORY}))"""
CARD = """id, term, name, house, seat, state, allocated, committed, paid, idle, committed_rate,
  paid_rate, works, in_queue, high_risk, party, party_short"""


def _cards(t):
    number = F.col("mp_id").cast("int") % 7
    profiles = t.members.filter("ls_term = 18").select(
        "mp_id", F.lit("").alias("profile_name"),
        F.concat(F.lit("Party "), number.cast("string")).alias("party"),
        F.concat(F.lit("P"), number.cast("string")).alias("party_short"),
        F.lit("Sitting").alias("status"))
    return desks.member_cards(desks.member_directory(t.members, t.scored, 18), profiles)


@query("member_cards", "E21 P21 P19", f"SELECT {CARD} FROM cards", extra=CARDS)
def member_cards(t):
    return _cards(t).drop("status", "unlisted")


@query("directory_sorted", "K9", f"""SELECT {CARD}, row_number() OVER (ORDER BY paid_rate DESC
  NULLS LAST, name, id) AS place FROM cards WHERE house = 'Lok Sabha' AND state = 'ASIA'
QUALIFY place <= 60""", extra=CARDS)
def directory_sorted(t):
    rows = desks.directory(_cards(t), house="Lok Sabha", state="ASIA", sort="paid").limit(60)
    rows = rows.drop("status", "unlisted")
    order = F.struct((-F.col("paid_rate")).alias("r"), F.col("name"), F.col("id"))
    # Sixty rows: the place is read off the sorted keys, nothing larger is collected.
    keys = rows.agg(F.sort_array(F.collect_list(order)).alias("keys"))
    return rows.join(F.broadcast(keys)).withColumn(
        "place", F.array_position("keys", order).cast("bigint")).drop("keys")


@query("directory_search", "K9", f"""SELECT {CARD} FROM cards WHERE party = 'Party 3'
  AND (contains(lower(name), 'seat 1') OR contains(lower(coalesce(seat, '')), 'seat 1')
    OR contains(lower(state), 'seat 1') OR contains(lower(party), 'seat 1'))""", extra=CARDS)
def directory_search(t):
    return desks.directory(_cards(t), q=" Seat 1 ", party="Party 3", sort="queue").drop(
        "status", "unlisted")


@query("directory_suggest", "K10", f"""SELECT {CARD} FROM cards WHERE id <> '7'
  AND (contains(lower(name), 'p3') OR contains(lower(coalesce(seat, '')), 'p3')
    OR lower(party_short) = 'p3')
ORDER BY starts_with(lower(name), 'p3') DESC, name, id LIMIT 6""", extra=CARDS)
def directory_suggest(t):
    return desks.suggest(_cards(t), "P3", exclude=["7"]).drop("status", "unlisted")


@query("parties_by_size", "A33", """SELECT party, count(*) AS members FROM cards GROUP BY 1""",
       extra=CARDS)
def parties_by_size(t):
    return desks.parties_by_size(_cards(t))


_MEASURES = ["allocated", "committed", "paid", "idle", "works", "in_queue", "high_risk"]


@query("compare_members", "A34", "SELECT id, name, measure, value, "
       f"""CASE WHEN peak > 0 THEN {r("value / peak * 100", 2)} END AS bar_pct
FROM (SELECT *, max(value) OVER (PARTITION BY measure) AS peak FROM (
  SELECT id, name, unnest({_MEASURES!r}) AS measure,
    unnest([{", ".join(f"{m}::DOUBLE" for m in _MEASURES)}]) AS value
  FROM cards WHERE id IN ('7', '13', '100')))""", extra=CARDS)
def compare_members(t):
    return desks.compare_members(_cards(t), ["7", "13", "100"])


@query("default_term", "P29", """SELECT mp_id, coalesce(max(ls_term) FILTER (ls_term = 17),
  max(ls_term)) AS ls_term FROM members WHERE mp_id = '7' GROUP BY 1""")
def default_term(t):
    return desks.default_term(t.members, MEMBER, 17)


@query("district_ranking", "A19", f"""SELECT state, district, count(*) AS total_projects,
  {HIGH} AS high_risk_count, {r(MEAN, 4)} AS avg_risk_score FROM scored GROUP BY 1, 2""")
def district_ranking(t):
    return desks.district_ranking(t.scored)


LEAGUE = f"""league AS (SELECT state, allocated, recommended, expenditure, mp_count,
  completed_works, recommended_works, {rate("expenditure", "allocated")} AS paid_rate,
  {rate("recommended", "allocated")} AS committed_rate,
  {rate("completed_works", "recommended_works")} AS completion_rate,
  coalesce(works, 0) AS works, coalesce(high_risk, 0) AS high_risk,
  coalesce(in_queue, 0) AS in_queue, coalesce(flagged_amount, 0) AS flagged_amount, avg_risk
FROM (SELECT state, sum(allocated_amount)::DOUBLE AS allocated,
    sum(amount_recommended)::DOUBLE AS recommended, sum(total_expenditure)::DOUBLE AS expenditure,
    count(DISTINCT mp_id) AS mp_count, sum(completed_works)::BIGINT AS completed_works,
    sum(recommended_works)::BIGINT AS recommended_works
  FROM members WHERE ls_term = 18 GROUP BY 1)
LEFT JOIN (SELECT state, count(*) AS works, {HIGH} AS high_risk, {IN_QUEUE} AS in_queue,
    {FLAGGED} AS flagged_amount, {r(MEAN, 1)} AS avg_risk
  FROM scored WHERE ls_term = 18 GROUP BY 1) USING (state))"""


@query("state_league", "A22 J6 E21", "SELECT * FROM league", extra=LEAGUE)
def state_league(t):
    return desks.state_league(t.members, t.scored, 18)


@query("state_ranking", "K8 E20", """SELECT *, CASE WHEN paid_rate >= 80 THEN 'high'
  WHEN paid_rate >= 50 THEN 'average' ELSE 'low' END AS band FROM league
ORDER BY coalesce(completion_rate, -1) DESC, state""", extra=LEAGUE)
def state_ranking(t):
    return desks.rank_states(desks.state_league(t.members, t.scored, 18), "completion")


# ------------------------------------------------------- forecast and trends

# From the definition: every open work says how its agency stands, the quartile is
# interpolated between its two neighbours among the agencies in order.
FORECAST = f"""unfinished AS (
  SELECT *, CASE WHEN expected_completion < {AS_OF} THEN 1 ELSE 0 END AS late,
    datediff('day', {AS_OF}, expected_completion) BETWEEN 0 AND 90 AS soon
  FROM works WHERE work_status <> 'completed' AND expected_completion IS NOT NULL
), standing AS (
  SELECT *, sum(late) OVER agency AS agency_late, count(*) OVER agency AS agency_open,
    row_number() OVER (PARTITION BY implementing_agency ORDER BY work_key) AS nth
  FROM unfinished WINDOW agency AS (PARTITION BY implementing_agency)
), ladder AS (
  SELECT agency_late::DOUBLE / agency_open AS rung,
    row_number() OVER (ORDER BY agency_late::DOUBLE / agency_open) - 1 AS step,
    count(*) OVER () AS steps
  FROM standing WHERE nth = 1 AND agency_open >= 20
), quartile AS (
  SELECT max(rung) FILTER (step <= 0.75 * (steps - 1)) AS below,
    coalesce(min(rung) FILTER (step > 0.75 * (steps - 1)), max(rung)) AS above,
    any_value(0.75 * (steps - 1) - floor(0.75 * (steps - 1)))::DOUBLE AS part,
    below + (above - below) * part AS c, any_value(steps) AS agencies_rated FROM ladder
), doubtful AS (
  SELECT *, agency_late::DOUBLE / agency_open AS rung FROM standing
  WHERE soon AND agency_open >= 20
    AND agency_late::DOUBLE / agency_open >= (SELECT c FROM quartile))"""


@query("forecast_summary", "A18 J8", f"""SELECT any_value({r("c", 6)}) AS cutoff_share,
  any_value(agencies_rated) AS agencies_rated,
  (SELECT count(*) FROM unfinished WHERE soon) AS due_in_window,
  count(work_key) AS likely_late, count(DISTINCT implementing_agency) AS agencies,
  {SANCTIONED} AS sanctioned, any_value({r("c * 100", 1)}) AS cutoff_pct
FROM quartile LEFT JOIN doubtful ON true""",
       extra=FORECAST)
def forecast_summary(t):
    return desks.late_forecast(t.scored, t.p)[0]


@query("forecast_agencies", "A18 K4", f"""SELECT implementing_agency, min(state) AS state,
  {r("any_value(rung) * 100", 1)} AS overdue_pct, any_value(agency_open) AS open_works,
  any_value(agency_late)::BIGINT AS overdue_works, count(*) AS due_works,
  {SANCTIONED} AS due_sanctioned, min(expected_completion) AS next_due
FROM doubtful GROUP BY 1 ORDER BY any_value(rung) DESC, count(*) DESC, implementing_agency LIMIT 6""", extra=FORECAST)
def forecast_agencies(t):
    return desks.late_forecast(t.scored, t.p)[1]


@query("agency_overdue_cut", "A18 F4", f"""SELECT count(*) AS n, {r("quantile_cont(rung, 0.5)", 6)}
  AS median_share, {r("quantile_cont(rung, 0.75)", 6)} AS cut_share FROM ladder""", extra=FORECAST)
def agency_overdue_cut(t):
    today = F.lit(t.p.as_of)
    rated = t.works.filter("work_status = 'recommended'").groupBy("implementing_agency").agg(
        (numeric.count_where(F.col("expected_completion") < today) / F.count(F.lit(1)))
        .alias("share"), F.count(F.lit(1)).alias("open_n")).filter("open_n >= 20")
    q = exact_percentiles(rated, [], "share", {"median_share": 0.5, "cut_share": 0.75})
    return q.select("n", *[numeric.rounded(c, 6).alias(c) for c in ("median_share", "cut_share")])


MONTHS = """months AS (SELECT strftime(expenditure_date, '%Y-%m') AS month, count(*) AS payments,
  sum(expenditure_amount)::DOUBLE AS amount FROM payments GROUP BY 1)"""


@query("monthly_trend", "A24", "SELECT * FROM months", extra=MONTHS)
def monthly_trend(t):
    return desks.monthly(t.payments)


@query("monthly_trend_state", "A24", """SELECT strftime(expenditure_date, '%Y-%m') AS month,
  count(*) AS payments, sum(expenditure_amount)::DOUBLE AS amount FROM payments
WHERE state = 'ASIA' GROUP BY 1""")
def monthly_trend_state(t):
    return desks.monthly(t.payments, STATE)


@query("month_bars", "A39", f"""SELECT month, amount, {r("greatest(amount / peak * 100, 2.0)", 4)}
  AS height, month LIKE '%-03' AS is_march
FROM months, (SELECT max(amount) AS peak FROM months)""", extra=MONTHS)
def month_bars(t):
    return desks.month_bars(desks.monthly(t.payments))


FISCAL = f"""fys AS (SELECT year(expenditure_date)
    - CASE WHEN month(expenditure_date) < 4 THEN 1 ELSE 0 END AS fy, count(*) AS payments,
  sum(expenditure_amount)::DOUBLE AS amount,
  {rate("count(*) FILTER (month(expenditure_date) = 3)", "count(*)")} AS march_share,
  min(expenditure_date) AS first_payment, max(expenditure_date) AS last_payment
  FROM payments GROUP BY 1)"""


@query("fiscal_trend", "A25 E15", "SELECT * FROM fys", extra=FISCAL)
def fiscal_trend(t):
    return desks.fiscal(t.payments)


@query("closed_years", "A37", "SELECT * FROM fys WHERE fy < (SELECT max(fy) FROM fys)",
       extra=FISCAL)
def closed_years(t):
    return desks.closed_years(desks.fiscal(t.payments))


def quiet_sql(where: str) -> str:
    return f"""SELECT implementing_agency, last_paid, payments, open_works, open_value,
  date_diff('day', last_paid, DATE '2001-11-10')::INTEGER AS days_silent
FROM (SELECT implementing_agency, max(expenditure_date) AS last_paid, count(*) AS payments
  FROM payments {where} GROUP BY 1)
JOIN (SELECT implementing_agency, count(*) FILTER (work_status = 'recommended') AS open_works,
  coalesce(sum(sanctioned_amount) FILTER (work_status = 'recommended'), 0)::DOUBLE AS open_value
  FROM works {where} GROUP BY 1) USING (implementing_agency)
WHERE last_paid < DATE '2001-11-10' - 15 AND open_works >= 20
ORDER BY open_value DESC, implementing_agency LIMIT 50"""


def _quiet_params(t):
    import datetime as dt
    return t.p.but(as_of=dt.date(2001, 11, 10))


@query("gone_quiet", "A26 J7", quiet_sql(""))
def gone_quiet(t):
    return desks.gone_quiet(t.payments, t.works, _quiet_params(t))


@query("gone_quiet_state", "A26 J7", quiet_sql("WHERE state = 'ASIA'"))
def gone_quiet_state(t):
    return desks.gone_quiet(t.payments, t.works, _quiet_params(t), STATE)


# ---------------------------------------------------------------- compliance

RULES = [("C-01", "Spending beyond the sanction", 60, "Expenditure exceeds sanctioned amount",
          "expenditure > sanctioned_amount"),
         ("C-02", "Recommended work with no schedule", 20,
          "Missing start or expected completion date",
          "work_status = 'recommended' AND (start_date IS NULL OR expected_completion IS NULL)"),
         ("C-03", "Completed with no completion date", 20,
          "Marked completed with no actual completion date",
          "work_status = 'completed' AND actual_completion IS NULL"),
         ("C-04", "Completed with no photograph", 30,
          "Completed work has no photographic documentation on record",
          "work_status = 'completed' AND has_images IS FALSE")]


@query("compliance_book", "A23", " UNION ALL ".join(
    f"""SELECT '{code}' AS code, '{name}' AS rule, {weight} AS weight, breaches, CASE
  WHEN breaches > 0 THEN 'breached' WHEN possible = 0 AND '{code}' <> 'C-01' THEN 'clear'
  ELSE 'inert' END AS status FROM (SELECT count(*) FILTER (list_contains(flagged_reasons,
  '{reason}')) AS breaches, count(*) FILTER ({test}) AS possible FROM scored)"""
    for code, name, weight, reason, test in RULES))
def compliance_book(t):
    return desks.compliance_book(t.works, t.scored)


@query("compliance_totals", "A23", """SELECT count(*) AS works_scored,
  count(*) FILTER (compliance_risk > 0) AS works_breaching, 15 AS weight_in_score FROM scored""")
def compliance_totals(t):
    return desks.compliance_totals(t.scored, t.p)


# --------------------------------------------------------------------- desks


def rollup_sql(where: str) -> str:
    return f"""SELECT count(*) AS works, count(*) FILTER (work_status = 'completed') AS completed,
  count(*) FILTER (work_status = 'recommended') AS pending, {HIGH} AS high_risk,
  {IN_QUEUE} AS in_queue, {SANCTIONED} AS sanctioned,
  coalesce(sum(expenditure), 0)::DOUBLE AS expenditure, {FLAGGED} AS flagged_amount,
  count(DISTINCT district) AS districts, count(DISTINCT implementing_agency) AS agencies,
  count(DISTINCT mp_id) AS members, {r(MEAN, 1)} AS avg_risk FROM scored {where}"""


@query("risk_rollup", "A28", rollup_sql(""))
def risk_rollup(t):
    return desks.risk_rollup(t.scored)


@query("queue_shares", "A35", f"""SELECT works, {rate("in_queue", "works")} AS queue_share,
  {rate("completed", "works")} AS completion_share FROM ({rollup_sql(f"WHERE {HERE}")})""")
def queue_shares(t):
    return desks.queue_shares(desks.risk_rollup(t.scored.filter(HERE)))


def _member(t, part, ls_term=None):
    return desks.member_desk(t.members, t.scored, t.findings, MEMBER, ls_term)[part]


@query("member_desk_terms", "A27", """SELECT mp_id, ls_term, mp_name,
  (allocated_amount - amount_recommended)::DOUBLE AS idle_amount, utilization_pct,
  completion_rate_pct, completed_works, recommended_works, pending_payments
FROM members WHERE mp_id = '7'""")
def member_desk_terms(t):
    return _member(t, "terms").select(
        "mp_id", "ls_term", "mp_name", "idle_amount", "utilization_pct", "completion_rate_pct",
        "completed_works", "recommended_works", "pending_payments")


@query("member_desk_works", "A27", f"""SELECT works, completed, pending, high_risk, in_queue,
  sanctioned, flagged_amount AS flagged_value, districts, agencies
FROM ({rollup_sql("WHERE mp_id = '7' AND ls_term = 18")})""")
def member_desk_works(t):
    return _member(t, "works", 18)


@query("member_desk_sectors", "A27 K4", f"""SELECT sector, count(*) AS works,
  {SANCTIONED} AS sanctioned FROM scored WHERE mp_id = '7' GROUP BY 1
ORDER BY works DESC, sector LIMIT 8""")
def member_desk_sectors(t):
    return _member(t, "sectors")


@query("member_desk_top", "A27 K3", """SELECT work_key, work_name, district,
  sanctioned_amount::DOUBLE AS sanctioned_amount, overall_risk_score, risk_level,
  array_to_string(flagged_reasons, ' | ') AS flagged_reasons FROM scored WHERE mp_id = '7'
ORDER BY overall_risk_score DESC, work_key LIMIT 10""")
def member_desk_top(t):
    return _member(t, "top_flagged")


@query("member_desk_findings", "A27 J17", """SELECT code, headline, severity, detector_name
FROM findings JOIN catalogue USING (code) WHERE subject_type = 'mp' AND subject = '7'""")
def member_desk_findings(t):
    return _member(t, "findings").drop("limit")


def _state(t, part):
    return desks.state_desk(t.members, t.scored, t.works, t.findings, STATE, 18)[part]


@query("state_desk_money", "A29", f"""SELECT sum(allocated_amount)::DOUBLE AS allocated,
  sum(amount_recommended)::DOUBLE AS recommended, sum(total_expenditure)::DOUBLE AS expenditure,
  count(DISTINCT mp_id) AS mp_count, sum(completed_works)::BIGINT AS completed_works,
  sum(recommended_works)::BIGINT AS recommended_works FROM members WHERE {HERE}""")
def state_desk_money(t):
    return _state(t, "money")


@query("state_desk_works", "A29 A28", rollup_sql(f"WHERE {HERE}"))
def state_desk_works(t):
    return _state(t, "works")


@query("state_desk_districts", "A29", f"""SELECT district, count(*) AS works,
  count(*) FILTER (work_status = 'completed') AS completed, {HIGH} AS high_risk,
  {IN_QUEUE} AS in_queue, {SANCTIONED} AS sanctioned, {FLAGGED} AS flagged_amount,
  count(DISTINCT implementing_agency) AS agencies, {r(MEAN, 1)} AS avg_risk
FROM scored WHERE {HERE} GROUP BY 1""")
def state_desk_districts(t):
    return _state(t, "districts")


@query("state_desk_members", "A29 K11 E21", f"""SELECT mp_id, mp_name, constituency, house,
  allocated_amount::DOUBLE AS allocated_amount, total_expenditure::DOUBLE AS total_expenditure,
  utilization_pct, completion_rate_pct, {rate("total_expenditure", "allocated_amount")} AS paid_pct,
  (allocated_amount - amount_recommended)::DOUBLE AS idle_amount, coalesce(works, 0) AS works,
  coalesce(in_queue, 0) AS in_queue
FROM members LEFT JOIN (SELECT mp_id, count(*) AS works, {IN_QUEUE} AS in_queue FROM scored
  WHERE {HERE} GROUP BY 1) USING (mp_id) WHERE {HERE}""")
def state_desk_members(t):
    return _state(t, "members")


@query("state_desk_sectors", "A29 K4", f"""SELECT sector, count(*) AS works,
  {SANCTIONED} AS sanctioned, {IN_QUEUE} AS in_queue FROM scored WHERE {HERE} GROUP BY 1
ORDER BY works DESC, sector LIMIT 10""")
def state_desk_sectors(t):
    return _state(t, "sectors")


@query("state_desk_top", "A29 K3", f"""SELECT work_key, work_name, district, implementing_agency,
  mp_name, sanctioned_amount::DOUBLE AS sanctioned_amount, overall_risk_score, risk_level,
  array_to_string(flagged_reasons, ' | ') AS flagged_reasons FROM scored WHERE {HERE}
ORDER BY overall_risk_score DESC, work_key LIMIT 10""")
def state_desk_top(t):
    return _state(t, "top_flagged")


@query("state_desk_findings", "A29 J9", f"""SELECT code, subject_type, subject, period, severity,
  headline, detector_name FROM findings f JOIN catalogue USING (code) WHERE f.ls_term = 18 AND (
  (f.subject_type = 'agency' AND f.subject IN (SELECT implementing_agency FROM works WHERE {HERE}))
  OR (f.subject_type = 'mp' AND f.subject IN (SELECT mp_id FROM members WHERE {HERE})))
ORDER BY severity DESC, code, subject, f.ls_term, period LIMIT 25""")
def state_desk_findings(t):
    return _state(t, "findings").drop("limit")


def _district(t, part):
    return desks.district_desk(t.scored, t.works, t.profile, t.findings, STATE, DISTRICT, 18)[part]


@query("district_desk_works", "A30 A28", rollup_sql(f"WHERE {THERE}"))
def district_desk_works(t):
    return _district(t, "works")


@query("district_desk_agencies", "A30 J4", f"""SELECT implementing_agency, works, completed,
  high_risk, in_queue, sanctioned, avg_risk, vendor_count, top_vendor, top_vendor_share_pct
FROM (SELECT implementing_agency, ls_term, count(*) AS works,
    count(*) FILTER (work_status = 'completed') AS completed, {HIGH} AS high_risk,
    {IN_QUEUE} AS in_queue, {SANCTIONED} AS sanctioned, {r(MEAN, 1)} AS avg_risk
  FROM scored WHERE {THERE} GROUP BY 1, 2)
LEFT JOIN (SELECT implementing_agency, ls_term, vendor_count, top_vendor, top_vendor_share_pct
  FROM profile) USING (implementing_agency, ls_term)""")
def district_desk_agencies(t):
    return _district(t, "agencies")


@query("district_desk_sectors", "A30 K4", f"""SELECT sector, count(*) AS works,
  {SANCTIONED} AS sanctioned, {IN_QUEUE} AS in_queue FROM scored WHERE {THERE} GROUP BY 1
ORDER BY works DESC, sector LIMIT 10""")
def district_desk_sectors(t):
    return _district(t, "sectors")


@query("district_desk_members", "A30 K4", f"""SELECT mp_id, max(mp_name) AS mp_name,
  max(constituency) AS constituency, count(*) AS works, {IN_QUEUE} AS in_queue,
  {SANCTIONED} AS sanctioned FROM scored WHERE {THERE} GROUP BY 1
ORDER BY works DESC, mp_id LIMIT 12""")
def district_desk_members(t):
    return _district(t, "members")


@query("district_desk_top", "A30 K3", f"""SELECT work_key, work_name, implementing_agency, mp_name,
  sector, work_status, sanctioned_amount::DOUBLE AS sanctioned_amount,
  expenditure::DOUBLE AS expenditure, delay_days, cost_deviation_pct, overall_risk_score,
  risk_level, array_to_string(flagged_reasons, ' | ') AS flagged_reasons
FROM scored WHERE {THERE} ORDER BY overall_risk_score DESC, work_key LIMIT 15""")
def district_desk_top(t):
    return _district(t, "top_flagged")


@query("district_desk_findings", "A30 J9", f"""SELECT code, subject_type, subject, period, severity,
  headline, detector_name FROM findings f JOIN catalogue USING (code) WHERE f.ls_term = 18
  AND f.subject_type = 'agency' AND f.subject IN (SELECT implementing_agency FROM works
    WHERE {THERE})
ORDER BY severity DESC, code, subject, f.ls_term, period LIMIT 20""")
def district_desk_findings(t):
    return _district(t, "findings").drop("limit")


@query("top_works", "K3", """SELECT work_key, overall_risk_score FROM scored
ORDER BY overall_risk_score DESC NULLS LAST, work_key LIMIT 15""")
def top_works(t):
    return queue.top_works(t.scored, 15).select("work_key", "overall_risk_score")


@query("state_keys", "P20", """SELECT DISTINCT lower(r_name) AS state_key FROM region""")
def state_keys(t):
    dressed = F.concat(F.lit(" The "), F.col("r_name"), F.lit(". "))
    return t.raw("region").select(state_key(dressed).alias("state_key")).distinct()
