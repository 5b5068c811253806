"""The domain tables and scores restated in SQL, as common table expressions.

Written apart from the Spark operators: the check SQL must not share code with what it checks.
"""

AS_OF = "DATE '2001-08-01'"


def r(expression: str, digits: int) -> str:
    return f"round(CAST({expression} AS DECIMAL(24,8)), {digits})::DOUBLE"


def ramp(value: str, floor: float, ceiling: float) -> str:
    return (f"CASE WHEN {value} IS NULL OR {value} <= {floor} THEN 0.0::DOUBLE ELSE "
            f"least(({value} - {floor}::DOUBLE) / ({ceiling}::DOUBLE - {floor}::DOUBLE) * 100, "
            f"100.0::DOUBLE) END")


def whole(value: str) -> str:
    return f"({r(value, 0)})::BIGINT::VARCHAR"


def grouped(value: str) -> str:
    return f"format('{{:,}}', ({r(value, 0)})::BIGINT)"


def pending(days: str) -> str:
    return r(ramp(days, 90, 730), 2)


HOUSE = "CASE WHEN o_custkey % 5 = 0 THEN 'Rajya Sabha' ELSE 'Lok Sabha' END"
SEAT = ("CASE WHEN o_custkey % 5 = 0 THEN CASE WHEN o_custkey % 10 = 0 THEN "
        "'Nominated Rajya Sabha' ELSE 'Sitting Rajya Sabha' END "
        "ELSE 'Seat ' || (o_custkey % 543)::VARCHAR END")

JOINED = """
joined AS (
  SELECT *, CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date,
    CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-01' THEN 17 ELSE 18 END AS ls_term,
    'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS member_name,
    l_extendedprice * (1 - l_discount) AS paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

WORKS = f"""
keyed_works AS (
  SELECT concat_ws('|', l_orderkey::VARCHAR || '-' || l_linenumber || '-' || l_partkey, ls_term,
                   s_name) AS work_key,
    l_orderkey AS order_id, p_name || ' ' || lower(p_type) AS description, ls_term,
    member_name AS mp_name, o_custkey::VARCHAR AS mp_id, {HOUSE} AS house,
    {SEAT} AS constituency, r_name AS state, n_name AS district, o_orderpriority AS category,
    s_name AS implementing_agency,
    l_extendedprice::DECIMAL(14,2) AS recommended_amount,
    l_extendedprice::DECIMAL(14,2) AS sanctioned_amount,
    CASE WHEN l_linestatus = 'F'
      THEN round(CAST(paid * (1 + l_tax) AS DECIMAL(24,8)), 2)::DECIMAL(14,2)
      ELSE 0::DECIMAL(14,2) END AS expenditure,
    CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'recommended' END AS work_status,
    order_date AS start_date, order_date + 365 AS expected_completion,
    CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN ship_date END AS actual_completion,
    'fixture' AS source,
    CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END AS has_images,
    upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
      || 's' AS sector
  FROM joined
), works AS (
  SELECT * FROM keyed_works QUALIFY row_number() OVER (PARTITION BY work_key
    ORDER BY sanctioned_amount, expenditure, work_status, actual_completion NULLS FIRST,
      has_images NULLS FIRST) = 1
)"""

PAYMENTS = f"""
payments AS (
  SELECT ls_term, member_name AS mp_name, o_custkey::VARCHAR AS mp_id, {SEAT} AS constituency,
    r_name AS state, n_name AS district, lower(p_type) AS work_type_text, p_brand AS vendor,
    s_name AS implementing_agency,
    round(CAST(paid AS DECIMAL(24,8)), 2)::DECIMAL(14,2) AS expenditure_amount,
    ship_date AS expenditure_date,
    CASE WHEN l_returnflag = 'R' THEN 'Payment In-Progress' ELSE 'Payment Success' END
      AS payment_status
  FROM joined
)"""

MEMBERS = f"""
member_money AS (
  SELECT o_custkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-01' THEN 17 ELSE 18 END
      AS ls_term, sum(o_totalprice::DECIMAL(14,2)) AS amount_recommended
  FROM orders GROUP BY 1, 2
), member_paid AS (
  SELECT o_custkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-01' THEN 17 ELSE 18 END
      AS ls_term,
    sum(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24,8)), 2)::DECIMAL(14,2))
      AS total_expenditure,
    count(*) FILTER (l_linestatus = 'F') AS completed_works, count(*) AS recommended_works,
    count(*) FILTER (l_returnflag = 'R') AS pending_payments
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
), members AS (
  SELECT o_custkey::VARCHAR AS mp_id, ls_term, c_name AS mp_name, {SEAT} AS constituency,
    r_name AS state, {HOUSE} AS house,
    round(CAST(amount_recommended::DOUBLE * (1 + (o_custkey % 10) / 10.0::DOUBLE)
               AS DECIMAL(24,8)), 2)::DECIMAL(14,2) AS allocated_amount,
    amount_recommended::DECIMAL(14,2) AS amount_recommended,
    total_expenditure::DECIMAL(14,2) AS total_expenditure,
    {r("100 * (amount_recommended::DOUBLE / round(CAST(amount_recommended::DOUBLE * (1 + (o_custkey % 10) / 10.0::DOUBLE) AS DECIMAL(24,8)), 2)::DOUBLE)", 2)}
      AS utilization_pct,
    completed_works, recommended_works,
    round(100 * CAST(completed_works / recommended_works AS DECIMAL(24,8)), 2)::DOUBLE
      AS completion_rate_pct,
    (amount_recommended - total_expenditure)::DECIMAL(14,2) AS unspent_amount,
    recommended_works AS transaction_count,
    recommended_works - pending_payments AS successful_payments, pending_payments
  FROM member_money JOIN member_paid USING (o_custkey, ls_term)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

PROFILE = f"""
vendor_spend AS (
  SELECT implementing_agency, ls_term, vendor, sum(expenditure_amount) AS spend
  FROM payments GROUP BY 1, 2, 3
), vendor_shape AS (
  SELECT implementing_agency, ls_term, count(*) AS vendor_count,
    sum(spend)::DOUBLE AS total_spend,
    sum(spend::DOUBLE * spend::DOUBLE) / (sum(spend)::DOUBLE * sum(spend)::DOUBLE) AS hhi,
    max(spend)::DOUBLE AS top_spend
  FROM vendor_spend GROUP BY 1, 2
), vendor_top AS (
  SELECT implementing_agency, ls_term, vendor AS top_vendor FROM vendor_spend
  QUALIFY row_number() OVER (PARTITION BY implementing_agency, ls_term
                             ORDER BY spend DESC, vendor) = 1
), paid_out AS (
  SELECT implementing_agency, ls_term, count(*) AS transaction_count,
    count(*) FILTER (payment_status <> 'Payment Success') AS pending_count,
    min(expenditure_date) FILTER (payment_status <> 'Payment Success') AS oldest
  FROM payments GROUP BY 1, 2
), profile AS (
  SELECT implementing_agency, ls_term, vendor_count, transaction_count, total_spend,
    {r("hhi", 4)} AS vendor_hhi, top_vendor,
    {r("top_spend / total_spend * 100", 2)} AS top_vendor_share_pct, pending_count,
    coalesce(date_diff('day', oldest, {AS_OF}), 0)::INTEGER AS oldest_pending_days,
    CASE WHEN transaction_count >= 20 THEN {r(ramp("hhi", 0.042, 0.050), 2)} ELSE 0.0 END
      AS concentration_risk
  FROM vendor_shape JOIN vendor_top USING (implementing_agency, ls_term)
  JOIN paid_out USING (implementing_agency, ls_term)
)"""

SIMILARITY = """
similarity AS (
  SELECT work_key, nullif(first_key, work_key) AS similar_work_key,
    (0.9::DOUBLE + ((order_id * 7 + length(work_key)) % 101) / 1000.0::DOUBLE)::DECIMAL(5,4)::DOUBLE
      AS max_similarity_score
  FROM works JOIN (SELECT order_id, min(work_key) AS first_key FROM works GROUP BY 1)
  USING (order_id)
)"""

DELAY_SIGNAL = "least(agency_delay_rate, 100.0::DOUBLE)"
PENDING = pending("oldest_pending_days")
BASIS = ("cost_deviation_pct > 40 AND peer_median_cost IS NOT NULL AND sanctioned_amount IS NOT "
         "NULL AND (peer_count IS NULL OR peer_count >= 8)")

SCORED = f"""
delayed AS (
  SELECT *, greatest(date_diff('day', expected_completion,
                               coalesce(actual_completion, {AS_OF})), 0)::INTEGER AS delay_days,
    {r("expenditure::DOUBLE / sanctioned_amount::DOUBLE", 4)} AS expenditure_ratio
  FROM works
), peer AS (
  SELECT district, sector, {r("median(sanctioned_amount::DOUBLE)", 2)} AS peer_median_cost,
    count(*) AS peer_count FROM works GROUP BY 1, 2
), agency_rate AS (
  SELECT implementing_agency,
    {r("(count(*) FILTER (delay_days > 60))::DOUBLE / count(*) * 100", 2)} AS agency_delay_rate
  FROM delayed GROUP BY 1
), based AS (
  SELECT *, CASE WHEN peer_count < 8 THEN 0.0 ELSE
      {r("(sanctioned_amount::DOUBLE - peer_median_cost) / peer_median_cost * 100", 2)} END
      AS cost_deviation_pct
  FROM delayed JOIN peer USING (district, sector)
  JOIN agency_rate USING (implementing_agency)
  LEFT JOIN profile USING (implementing_agency, ls_term)
  JOIN similarity USING (work_key)
), risked AS (
  SELECT *,
    CASE WHEN peer_count < 8 THEN 0.0 ELSE greatest(least(cost_deviation_pct, 100.0), 0.0) END
      AS cost_risk,
    least(delay_days / 180.0::DOUBLE * 100, 100.0::DOUBLE) AS delay_risk,
    CASE WHEN max_similarity_score < 0.94::DOUBLE THEN 0.0::DOUBLE ELSE greatest(least(
      (max_similarity_score - 0.94::DOUBLE) / (1.0::DOUBLE - 0.94::DOUBLE) * 100, 100.0::DOUBLE),
      0.0::DOUBLE) END AS duplicate_risk,
    {r(f"greatest({DELAY_SIGNAL}, coalesce(concentration_risk, 0.0), {PENDING})", 2)} AS agency_risk,
    least(CASE WHEN expenditure > sanctioned_amount THEN 60.0 ELSE 0.0 END
      + CASE WHEN work_status = 'recommended' AND (start_date IS NULL
             OR expected_completion IS NULL) THEN 20.0 ELSE 0.0 END
      + CASE WHEN work_status = 'completed' AND actual_completion IS NULL THEN 20.0 ELSE 0.0 END
      + CASE WHEN work_status = 'completed' AND has_images IS FALSE THEN 30.0 ELSE 0.0 END,
      100.0)::DOUBLE AS compliance_risk
  FROM based
), totalled AS (
  SELECT *, {r("cost_risk * 0.25::DOUBLE + delay_risk * 0.25::DOUBLE + duplicate_risk * 0.2::DOUBLE + agency_risk * 0.15::DOUBLE + compliance_risk * 0.15::DOUBLE", 2)}
    AS overall_risk_score
  FROM risked
), reasoned AS (
  SELECT *, CASE WHEN overall_risk_score < 40 THEN 'LOW' WHEN overall_risk_score < 70
      THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    list_filter([
      CASE WHEN expenditure > sanctioned_amount THEN 'Expenditure exceeds sanctioned amount' END,
      CASE WHEN work_status = 'recommended' AND (start_date IS NULL
           OR expected_completion IS NULL) THEN 'Missing start or expected completion date' END,
      CASE WHEN work_status = 'completed' AND actual_completion IS NULL
           THEN 'Marked completed with no actual completion date' END,
      CASE WHEN work_status = 'completed' AND has_images IS FALSE
           THEN 'Completed work has no photographic documentation on record' END,
      CASE WHEN {BASIS} THEN '₹' || {grouped("sanctioned_amount::DOUBLE")} || ' against a ₹'
        || {grouped("peer_median_cost")} || ' median for ' || sector || ' works in ' || district
        || ' (' || {whole("cost_deviation_pct")} || '% above, ' || peer_count || ' peer works)' END,
      CASE WHEN delay_risk > 40 THEN delay_days || ' days beyond expected completion' END,
      CASE WHEN duplicate_risk > 40 THEN {whole("max_similarity_score * 100")}
        || '% similarity with another nearby work' END,
      CASE WHEN agency_risk > 40 THEN CASE
        WHEN greatest({DELAY_SIGNAL}, coalesce(concentration_risk, 0.0), {PENDING})
             = {DELAY_SIGNAL} THEN 'Implementing agency has a ' || {whole(DELAY_SIGNAL)}
             || '% delay rate across its projects'
        WHEN coalesce(concentration_risk, 0.0) >= {PENDING} THEN {whole("top_vendor_share_pct")}
             || '% of this agency''s ₹' || {grouped("total_spend")}
             || ' spend went to one vendor (' || top_vendor || '), across ' || vendor_count
             || CASE WHEN vendor_count = 1 THEN ' vendor' ELSE ' vendors' END || ' and '
             || transaction_count
             || CASE WHEN transaction_count = 1 THEN ' transaction' ELSE ' transactions' END
        ELSE pending_count || CASE WHEN pending_count = 1 THEN ' payment' ELSE ' payments' END
             || ' still in progress, oldest ' || oldest_pending_days || ' days' END END
    ], lambda x: x IS NOT NULL) AS flagged_reasons
  FROM totalled
), scored AS (
  SELECT *, left(description, 60) AS work_name FROM reasoned
)"""

EVENTS = """
decision_rows AS (
  SELECT event_id, user_id, ts AS created_at, 'note ' || event_id AS note,
    'reviewer ' || user_id AS reviewer,
    CASE event_type WHEN 'click' THEN 'verified' WHEN 'view' THEN 'dismissed'
      WHEN 'error' THEN 'escalated' WHEN 'signup' THEN 'pending' END AS status
  FROM events WHERE event_type IN ('click', 'view', 'error', 'signup')
), accepted_events AS (
  SELECT event_id, work_key, status, note, reviewer, created_at
  FROM decision_rows JOIN works ON user_id = order_id
), verdicts AS (
  SELECT work_key, status, note, reviewer, created_at AS updated_at FROM (
    SELECT * FROM accepted_events QUALIFY row_number() OVER (
      PARTITION BY work_key ORDER BY created_at DESC, event_id DESC) = 1)
  WHERE status <> 'pending'
), reviewed AS (
  SELECT s.*, coalesce(v.status, 'pending') AS review_status, v.note AS review_note,
    v.reviewer AS review_reviewer, v.updated_at AS review_updated_at
  FROM scored s LEFT JOIN verdicts v USING (work_key)
)"""

SHARES = [f"(log10(1 + 1.0::DOUBLE / {d}) * 100)" for d in range(1, 10)]

FINDINGS = f"""
years AS (
  SELECT implementing_agency, ls_term, year(expenditure_date)
      - CASE WHEN month(expenditure_date) < 4 THEN 1 ELSE 0 END AS start_year,
    count(*) AS payments, count(*) FILTER (month(expenditure_date) = 3) AS march_payments,
    coalesce(sum(expenditure_amount) FILTER (month(expenditure_date) = 3), 0)::DOUBLE
      AS march_amount, sum(expenditure_amount)::DOUBLE AS total_amount
  FROM payments WHERE expenditure_date IS NOT NULL GROUP BY 1, 2, 3
), d01 AS (
  SELECT *, start_year || '-' || CASE WHEN start_year % 100 = 99 THEN '100'
      ELSE lpad((start_year % 100 + 1)::VARCHAR, 2, '0') END AS fy,
    march_payments::DOUBLE / payments * 100 AS share,
    {ramp("(march_payments::DOUBLE / payments * 100)", 10, 30)} AS sev
  FROM years WHERE payments >= 10
), digits AS (
  SELECT implementing_agency, ls_term, floor(expenditure_amount::DOUBLE
      / pow(10.0, floor(log10(expenditure_amount::DOUBLE))))::INTEGER AS digit
  FROM payments WHERE abs(expenditure_amount) >= 1
), digit_counts AS (
  SELECT implementing_agency, ls_term, count(*) AS payments,
    {", ".join(f"count(*) FILTER (digit = {d}) AS d{d}" for d in range(1, 10))}
  FROM digits GROUP BY 1, 2 HAVING count(*) >= 150
), gaps AS (
  SELECT *, [{", ".join(f"abs(d{d}::DOUBLE / payments * 100 - {SHARES[d - 1]})" for d in range(1, 10))}] AS gap,
    [{", ".join(r(f"d{d}::DOUBLE / payments * 100", 2) for d in range(1, 10))}] AS observed,
    [{", ".join(r(SHARES[d - 1], 2) for d in range(1, 10))}] AS expected
  FROM digit_counts
), d02 AS (
  SELECT *, list_position(gap, list_max(gap)) AS worst_digit,
    list_sum(gap) / 9 AS raw_mad, {r("list_sum(gap) / 9", 3)} AS mad,
    {ramp("(list_sum(gap) / 9)", 5.9, 7.2)} AS sev
  FROM gaps
), funds AS (
  SELECT * FROM members WHERE allocated_amount >= 100000 AND recommended_works >= 3
  QUALIFY row_number() OVER (PARTITION BY mp_id, allocated_amount, amount_recommended
                             ORDER BY ls_term DESC) = 1
), d03 AS (
  SELECT *, greatest((allocated_amount::DOUBLE - amount_recommended::DOUBLE)
                     / allocated_amount::DOUBLE * 100, 0.0::DOUBLE) AS share,
    {ramp("greatest((allocated_amount::DOUBLE - amount_recommended::DOUBLE) / allocated_amount::DOUBLE * 100, 0.0::DOUBLE)", 20, 45)} AS sev
  FROM funds
), findings AS (
  SELECT 'D-01' AS code, 'agency' AS subject_type, implementing_agency AS subject, ls_term,
    fy AS period, {r("sev", 2)} AS severity,
    {whole("share")} || '% of this agency''s ' || payments || ' payments in FY ' || fy
      || ' were made in March alone' AS headline
  FROM d01 WHERE sev > 0
  UNION ALL
  SELECT 'D-02', 'agency', implementing_agency, ls_term, NULL, {r("sev", 2)},
    'Leading digits across ' || payments || ' payments depart from the expected distribution (MAD '
      || printf('%.2f', {r("mad", 2)}) || '); digit ' || worst_digit || ' appears '
      || printf('%.1f', {r("observed[worst_digit]", 1)}) || '% against '
      || printf('%.1f', {r("expected[worst_digit]", 1)}) || '% expected'
  FROM d02 WHERE sev > 0
  UNION ALL
  SELECT 'D-03', 'mp', mp_id, ls_term, NULL, {r("sev", 2)},
    mp_name || ' has never committed ' || {whole("share")}
      || '% of the allocation to any work, across ' || recommended_works
      || ' works recommended and ' || completed_works || ' completed'
  FROM d03 WHERE sev > 0
)"""

CATALOGUE = """
catalogue(code, detector_name, subject_kind) AS (VALUES
  ('D-01', 'Year-end payment burst', 'agency'), ('D-02', 'First-digit anomaly', 'agency'),
  ('D-03', 'Idle allocation', 'mp'), ('D-04', 'Uniform sanction amount', 'agency'))"""


def with_base(sql: str, extra: str = "") -> str:
    parts = [JOINED, WORKS, PAYMENTS, MEMBERS, PROFILE, SIMILARITY, SCORED, EVENTS, FINDINGS,
             CATALOGUE]
    if extra:
        parts.append(extra)
    return "WITH " + ",".join(parts) + "\n" + sql
