"""The review queue, the register, findings lists, search and the review ledger."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import ledger, postings
from ..plans import queue, search
from ..session import cut, shared_dir
from .registry import query

PAGE = """work_key, work_name, state, district, sector, implementing_agency,
  sanctioned_amount::DOUBLE AS sanctioned_amount, overall_risk_score, risk_level"""
PAGE_COLUMNS = ["work_key", "work_name", "state", "district", "sector", "implementing_agency",
                "sanctioned_amount", "overall_risk_score", "risk_level"]


@query("queue_page", "K1 J3 P22 P28", """SELECT work_key, work_name, description, ls_term, state,
  district, sector, category, implementing_agency, mp_name, constituency,
  sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure::DOUBLE AS expenditure, work_status,
  delay_days, cost_deviation_pct, peer_median_cost, peer_count, max_similarity_score,
  similar_work_key, cost_risk::DOUBLE AS cost_risk, delay_risk, duplicate_risk, agency_risk,
  compliance_risk, overall_risk_score, risk_level,
  array_to_string(flagged_reasons, ' | ') AS flagged_reasons, review_status, review_note,
  review_reviewer, strftime(review_updated_at, '%Y-%m-%d %H:%M:%S.%f') AS review_updated_at
FROM reviewed WHERE overall_risk_score >= 40
ORDER BY overall_risk_score DESC NULLS LAST, work_key LIMIT 50 OFFSET 50""")
def queue_page(t):
    return queue.queue_page(t.scored, t.verdicts, 50, 50, **queue.queue_scope())


@query("queue_filtered", "K1 P22 J3", f"""SELECT {PAGE}, review_status FROM reviewed
WHERE state = 'ASIA' AND ls_term = 18 AND overall_risk_score >= 40 AND (
  contains(lower(work_name), 'red') OR contains(lower(description), 'red')
  OR contains(lower(mp_name), 'red') OR contains(lower(district), 'red')
  OR contains(lower(state), 'red') OR contains(lower(implementing_agency), 'red'))
ORDER BY overall_risk_score DESC, work_key LIMIT 100""")
def queue_filtered(t):
    return queue.queue_page(t.scored, t.verdicts, 100, 0, q="red", state="ASIA", ls_term=18,
                            min_score=40).select(*PAGE_COLUMNS, "review_status")


@query("queue_by_verdict", "P22 J3", """SELECT review_status, count(*) AS works FROM reviewed
WHERE overall_risk_score >= 40 GROUP BY 1""")
def queue_by_verdict(t):
    return queue.alert_filters(queue.with_reviews(t.scored, t.verdicts), min_score=40).groupBy(
        "review_status").agg(F.count(F.lit(1)).alias("works"))


@query("queue_escalated", "P22 K1", f"""SELECT {PAGE}, review_note FROM reviewed
WHERE review_status = 'escalated' ORDER BY overall_risk_score DESC, work_key LIMIT 200""")
def queue_escalated(t):
    return queue.queue_page(t.scored, t.verdicts, 200, status="escalated").select(
        *PAGE_COLUMNS, "review_note")


@query("queue_total", "K1", """SELECT count(*) AS total FROM reviewed
WHERE overall_risk_score >= 40""")
def queue_total(t):
    return queue.queue_total(t.scored, t.verdicts, **queue.queue_scope())


@query("queue_compliance_total", "P22 A23", """SELECT count(*) AS total FROM scored
WHERE compliance_risk > 0""")
def queue_compliance_total(t):
    return queue.queue_total(t.scored, t.verdicts, compliance="breach")


@query("queue_member_band", "P22 P28", f"""SELECT {PAGE} FROM scored
WHERE mp_id = '7' AND risk_level = 'LOW' ORDER BY overall_risk_score DESC, work_key LIMIT 50""")
def queue_member_band(t):
    return queue.queue_page(t.scored, t.verdicts, mp_id="7", **queue.queue_scope("LOW")).select(
        *PAGE_COLUMNS)


@query("queue_empty_state", "P22", "SELECT count(*) AS total FROM scored WHERE state = ''")
def queue_empty_state(t):
    return queue.queue_total(t.scored, t.verdicts, state="")


TILES = """SELECT count(*) AS in_scope, count(*) FILTER (review_status = 'pending') AS pending,
  count(*) FILTER (review_status = 'escalated') AS escalated,
  count(*) FILTER (review_status = 'verified') AS verified,
  count(*) FILTER (review_status = 'dismissed') AS dismissed,
  count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium,
  coalesce(sum(sanctioned_amount) FILTER (review_status = 'pending'), 0)::DOUBLE
    AS pending_sanctioned_amount FROM reviewed"""


@query("queue_summary", "A20", TILES + " WHERE overall_risk_score >= 40")
def queue_summary(t):
    return queue.queue_summary(t.scored, t.verdicts)


@query("queue_tiles_all", "A20 P28", TILES + " WHERE district = 'NATION_2'")
def queue_tiles_all(t):
    return queue.summary_tiles(t.scored, t.verdicts, band="ALL", status="verified",
                               district="NATION_2")


@query("queue_tiles_low", "A20 P28", TILES + " WHERE risk_level = 'LOW'")
def queue_tiles_low(t):
    return queue.summary_tiles(t.scored, t.verdicts, band="LOW")


@query("queue_export", "S9", """SELECT work_key, trim(regexp_replace(work_name, '\\s+', ' ', 'g'))
  AS work_name, state, district, sector, implementing_agency, mp_name, work_status,
  sanctioned_amount::DOUBLE AS sanctioned_amount, expenditure::DOUBLE AS expenditure, delay_days,
  cost_deviation_pct, overall_risk_score AS risk_score, risk_level AS risk_band, review_status,
  array_to_string(flagged_reasons, ' | ') AS why_flagged
FROM reviewed WHERE overall_risk_score >= 40 ORDER BY overall_risk_score DESC, work_key
LIMIT 5000""")
def queue_export(t):
    return queue.export_queue(t.scored, t.verdicts)


@query("high_ticker", "K3", f"""SELECT {PAGE} FROM scored WHERE risk_level = 'HIGH'
  AND overall_risk_score >= 70 ORDER BY overall_risk_score DESC, work_key LIMIT 18""")
def high_ticker(t):
    return queue.ticker(t.scored, t.verdicts).select(*PAGE_COLUMNS)


@query("register_page", "K2 P23", """SELECT work_key, work_name, ls_term, state, district,
  category, sector, implementing_agency, sanctioned_amount::DOUBLE AS sanctioned_amount,
  overall_risk_score, risk_level
FROM scored WHERE risk_level = 'MEDIUM' AND (contains(lower(work_name), 'plate')
  OR contains(lower(mp_name), 'plate') OR contains(lower(district), 'plate')
  OR contains(lower(state), 'plate') OR contains(lower(implementing_agency), 'plate'))
ORDER BY overall_risk_score DESC, work_key LIMIT 50 OFFSET 100""")
def register_page(t):
    return queue.register_page(t.scored, 50, 100, q="Plate", state="", risk_level="MEDIUM")


@query("work_by_key", "K12", """SELECT work_key, work_name, overall_risk_score,
  array_to_string(flagged_reasons, ' | ') AS flagged_reasons FROM scored
WHERE work_key = (SELECT min(work_key) FROM works WHERE order_id = 7)""")
def work_by_key(t):
    key = t.works.filter("order_id = 7").agg(F.min("work_key").alias("k")).first()["k"]
    return queue.work_by_key(t.scored, key).select(
        "work_key", "work_name", "overall_risk_score", "flagged_reasons")


FINDING = "code, subject_type, subject, ls_term, period, severity, headline"


@query("findings_page", "K5 P24", f"""SELECT {FINDING} FROM findings
ORDER BY severity DESC, code, subject, ls_term, period LIMIT 50""")
def findings_page(t):
    return queue.findings_page(t.findings).drop("evidence")


@query("findings_filtered", "K5 P24", f"""SELECT {FINDING} FROM findings
WHERE subject_type = 'agency' AND ls_term = 17 AND (contains(lower(subject), 'in march')
  OR contains(lower(headline), 'in march'))
ORDER BY severity DESC, code, subject, ls_term, period LIMIT 200""")
def findings_filtered(t):
    return queue.findings_page(t.findings, 200, subject_type="agency", ls_term=17,
                               q="IN MARCH").drop("evidence")


# --------------------------------------------------------------------- search


@query("search_works", "K6 E23", f"""SELECT work_key, work_name, state, district, sector,
  implementing_agency, mp_name, sanctioned_amount::DOUBLE AS sanctioned_amount,
  overall_risk_score, risk_level
FROM (SELECT *, strpos(lower(work_name), 'old') AS spot FROM scored)
WHERE contains(lower(work_name), 'old') OR contains(lower(implementing_agency), 'old')
  OR contains(lower(mp_name), 'old')
ORDER BY CASE WHEN spot = 1 THEN 0 WHEN spot > 1 AND substr(work_name, spot - 1, 1) = ' ' THEN 1
    WHEN spot > 1 THEN 2 ELSE 3 END, CASE WHEN spot > 0 THEN spot - 1 ELSE 9999 END,
  overall_risk_score DESC, work_key LIMIT 20""")
def search_works(t):
    return search.search_works(t.scored, "OLD", 20)


@query("search_index", "A13 U4", """SELECT DISTINCT 'State' AS kind, state AS label,
  NULL AS sub, NULL AS entity_id FROM works
UNION ALL SELECT DISTINCT 'District', district, state, NULL FROM works
UNION ALL SELECT DISTINCT 'Agency', implementing_agency, NULL, NULL FROM works
UNION ALL SELECT 'Member', mp_name, constituency || ' · ' || state, mp_id || '|' || ls_term
FROM (SELECT DISTINCT mp_id, mp_name, state, constituency, ls_term FROM works)""")
def search_index(t):
    return search.search_index(t.works)


@query("search_entities", "K7 P19", """SELECT kind, label, sub, entity_id, rank FROM (
  SELECT kind, label, sub, entity_id, strpos(lower(label), 'a') AS spot,
    round(((CASE WHEN spot = 1 THEN 0.0 WHEN substr(lower(label), spot - 1, 1) IN
        (' ', '(', ',', '-', '/') THEN 1 + (spot - 1) / 1000.0 ELSE 2 + (spot - 1) / 1000.0 END)
      + CASE kind WHEN 'State' THEN 0.1 WHEN 'District' THEN 0.2 WHEN 'Member' THEN 0.3
        ELSE 0.4 END)::DECIMAL(12,4), 4)::DOUBLE AS rank
  FROM (SELECT DISTINCT 'State' AS kind, state AS label, NULL AS sub, NULL AS entity_id FROM works
    UNION ALL SELECT DISTINCT 'District', district, state, NULL FROM works
    UNION ALL SELECT DISTINCT 'Agency', implementing_agency, NULL, NULL FROM works
    UNION ALL SELECT 'Member', mp_name, constituency || ' · ' || state, mp_id || '|' || ls_term
    FROM (SELECT DISTINCT mp_id, mp_name, state, constituency, ls_term FROM works)))
WHERE spot > 0 ORDER BY rank, length(label), label, sub NULLS FIRST, entity_id NULLS FIRST
LIMIT 8""")
def search_entities(t):
    return search.search_entities(search.search_index(t.works), "A")


# ------------------------------------------------------- search by posted runs


def _grams(field: str) -> str:
    return f"""SELECT DISTINCT '{field}' AS field, work_key,
    substr(lower({field}) || chr(1) || chr(1), unnest(range(1, length({field}) + 1)), 3) AS run
  FROM scored"""


@query("posted_runs", "K6 E23", f"""SELECT field, length(trim(run, chr(1))) AS letters,
  count(DISTINCT run) AS runs, count(*) AS places, max(works) AS most FROM (
  SELECT field, run, count(*) OVER (PARTITION BY field, run) AS works FROM (
    {" UNION ALL ".join(_grams(f) for f in search.WORK_TEXTS)}))
GROUP BY 1, 2""")
def posted_runs(t):
    per_run = t.work_index.postings.groupBy("field", "run").agg(
        F.sum(F.size("places")).alias("works"))
    return per_run.groupBy("field", F.length(F.rtrim(F.col("run"), F.lit(postings.PAD))).alias(
        "letters")).agg(F.count(F.lit(1)).alias("runs"), F.sum("works").alias("places"),
                        F.max("works").alias("most"))


@query("search_works_posted", "K6 E23", f"""SELECT work_key, work_name, state, district, sector,
  implementing_agency, mp_name, sanctioned_amount::DOUBLE AS sanctioned_amount,
  overall_risk_score, risk_level
FROM (SELECT *, strpos(lower(work_name), 'widget e') AS spot FROM scored)
WHERE contains(lower(work_name), 'widget e') OR contains(lower(implementing_agency), 'widget e')
  OR contains(lower(mp_name), 'widget e')
ORDER BY CASE WHEN spot = 1 THEN 0 WHEN spot > 1 AND substr(work_name, spot - 1, 1) = ' ' THEN 1
    WHEN spot > 1 THEN 2 ELSE 3 END, CASE WHEN spot > 0 THEN spot - 1 ELSE 9999 END,
  overall_risk_score DESC, work_key LIMIT 20""")
def search_works_posted(t):
    q = "Widget E"
    rows = postings.candidates(t.work_index, search.RANKED_TEXTS, q)
    return search.search_works(rows, q, 20)


@query("queue_posted", "K1 P22 J3", f"""SELECT {PAGE}, review_status FROM reviewed
WHERE overall_risk_score >= 40 AND (
  contains(lower(work_name), 'g ') OR contains(lower(description), 'g ')
  OR contains(lower(mp_name), 'g ') OR contains(lower(district), 'g ')
  OR contains(lower(state), 'g ') OR contains(lower(implementing_agency), 'g '))
ORDER BY overall_risk_score DESC, work_key LIMIT 100""")
def queue_posted(t):
    rows = postings.candidates(t.work_index, search.WORK_TEXTS, "g ")
    return queue.queue_page(rows, t.verdicts, 100, 0, q="g ", min_score=40).select(
        *PAGE_COLUMNS, "review_status")


@query("register_posted", "K2 P23", f"""SELECT {PAGE} FROM scored
WHERE contains(lower(work_name), 'bolt sm') OR contains(lower(mp_name), 'bolt sm')
  OR contains(lower(district), 'bolt sm') OR contains(lower(state), 'bolt sm')
  OR contains(lower(implementing_agency), 'bolt sm')
ORDER BY overall_risk_score DESC, work_key LIMIT 200""")
def register_posted(t):
    rows = postings.candidates(t.work_index, search.WORK_TEXTS, "bolt sm")
    return queue.register_page(rows, 200, q="bolt sm").select(*PAGE_COLUMNS)


@query("search_entities_posted", "K7", """SELECT kind, label, sub, entity_id FROM (
  SELECT DISTINCT 'State' AS kind, state AS label, NULL AS sub, NULL AS entity_id FROM works
  UNION ALL SELECT DISTINCT 'District', district, state, NULL FROM works
  UNION ALL SELECT DISTINCT 'Agency', implementing_agency, NULL, NULL FROM works
  UNION ALL SELECT 'Member', mp_name, constituency || ' · ' || state, mp_id || '|' || ls_term
  FROM (SELECT DISTINCT mp_id, mp_name, state, constituency, ls_term FROM works))
WHERE contains(lower(label), 'er#00000000')
ORDER BY CASE kind WHEN 'State' THEN 1 WHEN 'District' THEN 2 WHEN 'Member' THEN 3 ELSE 4 END,
  length(label), label, sub NULLS FIRST, entity_id NULLS FIRST LIMIT 40""")
def search_entities_posted(t):
    q = "er#00000000"
    rows = postings.candidates(t.entity_index, ["label"], q)
    return search.search_entities(rows, q, 40).drop("rank")


# --------------------------------------------------------------------- ledger


@query("current_verdicts", "L1 L2 W6", """SELECT work_key, status, note, reviewer,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM verdicts""")
def current_verdicts(t):
    good, _ = ledger.accepted(t.review_events, t.works)
    return ledger.current_verdict(*ledger.split_events(good))


@query("verdicts_compacted", "L1 L2 W6", """SELECT work_key, status, note, reviewer,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM verdicts""")
def verdicts_compacted(t):
    root = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    # Cut: every batch is taken from it, and none should look up the works again.
    good = cut(ledger.accepted(t.review_events, t.works)[0], "accepted")
    # Batches cut across time, so that events come late; the last is left to the tail.
    for batch in range(4):
        ledger.append_batch(good.filter(F.col("event_id") % 4 == batch), root, batch)
        if batch in (1, 2):
            ledger.compact(t.spark, root, batch)
    return ledger.verdicts_of(ledger.latest_events(t.spark, root))


@query("refused_decisions", "L1", """SELECT refused, count(*) AS events,
  count(DISTINCT 'order ' || user_id) AS subjects
FROM (SELECT user_id, CASE WHEN user_id % 10 = 3 THEN 'Unknown status'
    WHEN order_id IS NULL THEN 'No work with that work_key' END AS refused
  FROM decision_rows LEFT JOIN (SELECT DISTINCT order_id FROM works) ON user_id = order_id
  WHERE status <> 'pending') WHERE refused IS NOT NULL GROUP BY 1""")
def refused_decisions(t):
    # One event per subject here: an order's lines share the verdict.
    user = F.regexp_extract("reviewer", r"(\d+)", 1).cast("bigint")
    per_event = t.review_events.filter("status <> 'pending'").groupBy("event_id").agg(
        F.min("work_key").alias("work_key"), F.max("status").alias("status"),
        F.max(user).alias("user"))
    spoiled = per_event.withColumn(
        "status", F.when(F.col("user") % 10 == 3, "unsure").otherwise(F.col("status")))
    _, refused = ledger.accepted(spoiled, t.works)
    return refused.groupBy("refused").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user").alias("subjects"))


@query("decision_history", "L3", """SELECT status, note, reviewer,
  strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM accepted_events
WHERE status <> 'pending' AND work_key = (SELECT min(work_key) FROM works WHERE order_id = 7)
ORDER BY created_at DESC, event_id DESC LIMIT 200""")
def decision_history(t):
    key = t.works.filter("order_id = 7").agg(F.min("work_key").alias("k")).first()["k"]
    good, _ = ledger.accepted(t.review_events, t.works)
    return ledger.history(ledger.split_events(good)[0], key)


@query("verdicts_as_of", "L2 W6", """SELECT work_key, status FROM (
  SELECT * FROM accepted_events WHERE created_at <= TIMESTAMP '2024-01-15 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY created_at DESC, event_id DESC) = 1)
WHERE status <> 'pending'""")
def verdicts_as_of(t):
    good, _ = ledger.accepted(t.review_events, t.works)
    seen = good.filter(F.col("created_at") <= F.lit(dt.datetime(2024, 1, 15)))
    return ledger.current_verdict(*ledger.split_events(seen)).select("work_key", "status")
