"""Reading, cleansing, rejecting, keying, labelling, publishing and reconciling."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, labels, peers, reconcile
from ..plans import scoring
from ..session import cut, joined_in_place, shared_dir
from ..sources import extracts, fixtures, publish, raw_fixtures, store, synthetic
from .base_sql import HOUSE, SEAT, r
from .registry import query

RAW = """raw AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS work_id,
    CASE WHEN l_orderkey % 97 = 0 THEN '  ' WHEN l_orderkey % 89 <> 0
      THEN p_name || ' ' || lower(p_type) END AS description,
    CASE WHEN l_orderkey % 7 <> 0 THEN o_orderpriority END AS raw_category,
    CASE WHEN l_orderkey % 83 = 0 THEN '' ELSE r_name END AS raw_state,
    CASE WHEN l_suppkey % 17 = 0 THEN '(' || s_name || '_IDA)'
      ELSE ' ' || lower(n_name) || '(' || s_name || '_IDA)' END AS ida,
    CASE l_partkey % 101 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '-5' WHEN 3 THEN '12.50'
      ELSE l_extendedprice::DECIMAL(14,2)::VARCHAR END AS amount,
    CASE WHEN l_returnflag = 'A' THEN TRUE WHEN l_returnflag = 'N' THEN FALSE END AS images,
    CASE WHEN l_returnflag = 'A' THEN 'True' WHEN l_returnflag = 'N' THEN 'False'
      WHEN l_partkey % 2 = 0 THEN 'maybe' END AS raw_images,
    concat_ws('|', work_id, ls_term, trim(ida)) AS work_key
  FROM joined
), rec AS (SELECT *, CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 THEN NULL
    ELSE order_date END AS start_date FROM raw WHERE l_linestatus = 'O' OR l_linenumber % 3 = 0
), com AS (SELECT * FROM raw WHERE l_linestatus = 'F'
), united AS (
  SELECT work_key, description, raw_state AS state,
    ida, amount, 'recommended' AS work_status, start_date, NULL::DATE AS actual_completion, images, raw_images,
    raw_category, ls_term, member_name, o_custkey, 'works_recommended_2001-08-01.csv' AS source_file
  FROM rec WHERE work_key NOT IN (SELECT work_key FROM com)
  UNION ALL
  SELECT work_key, com.description, com.raw_state,
    com.ida, com.amount, 'completed', rec.start_date,
    CASE WHEN com.l_returnflag <> 'R' THEN com.ship_date END, com.images, com.raw_images,
    com.raw_category,
    com.ls_term, com.member_name, com.o_custkey,
    CASE WHEN com.l_orderkey % 3 = 0 THEN 'works_completed_2001-07-01.csv'
      ELSE 'works_completed_2001-08-01.csv' END
  FROM com LEFT JOIN rec USING (work_key)
), judged AS (
  SELECT *, try_cast(amount AS DOUBLE) AS value, CASE
    WHEN value > 0 AND value < 1000 THEN 'Sanctioned amount below Rs 1000 floor'
    WHEN value <= 0 THEN 'Sanctioned amount is not positive'
    WHEN value IS NULL THEN 'Missing or non-numeric sanctioned amount'
    WHEN trim(coalesce(description, '')) = '' THEN 'Missing or empty work description'
    WHEN trim(state) = '' THEN 'Missing state' END AS reason FROM united
)"""
DISTRICT = ("coalesce(nullif(upper(trim(split_part(ida, '(', 1))), ''), upper(trim(ida)))")


def _united(t):
    return ingest.unite_works(raw_fixtures.recommended(t.spark, t.sf_dir, t.lines),
                              raw_fixtures.completed(t.spark, t.sf_dir, t.lines))


@query("unite_works", "P3 P4 J10 U1 W4 P2", """SELECT work_key, work_status, start_date,
  actual_completion, amount FROM united""", extra=RAW)
def unite_works(t):
    return _united(t).select("work_key", "work_status", "start_date", "actual_completion", "amount")


RAW_FIELDS = ("work_key", "description", "category", "ls_term", "state", "implementing_agency",
              "amount", "work_status", "start_date", "actual_completion", "has_images")


@query("rejected_works", "P5", """SELECT work_key, description, raw_category AS category,
  ls_term::VARCHAR AS ls_term, state, ida AS implementing_agency, amount, work_status,
  start_date::VARCHAR AS start_date, actual_completion::VARCHAR AS actual_completion,
  raw_images AS has_images, reason, source_file FROM judged
WHERE reason IS NOT NULL""", extra=RAW)
def rejected_works(t):
    """Each reject with the raw values it came with."""
    _, rejects = ingest.route_rejects(_united(t), t.p)
    return rejects.select(*[F.element_at("raw_row", c).alias(c) for c in RAW_FIELDS], "reason",
                          "source_file")


@query("reject_summary", "P6", """SELECT reason, count(*) AS rows FROM judged
WHERE reason IS NOT NULL AND source_file LIKE '%2001-08-01%' GROUP BY 1""", extra=RAW)
def reject_summary(t):
    return ingest.reject_summary(ingest.route_rejects(_united(t), t.p)[1])


@query("loaded_works", "P1 P7 P8 P13", f"""SELECT work_key, trim(description) AS description,
  ls_term, member_name AS mp_name, substr(sha1('customer ' || lpad(o_custkey::VARCHAR, 9, '0')
    || '|' || lower(state) || '|' || CASE WHEN o_custkey % 5 = 0 THEN 'rajya sabha'
    ELSE 'lok sabha' END), 1, 16) AS mp_id, state, {DISTRICT} AS district,
  coalesce(raw_category, 'Unknown') AS category, value AS sanctioned_amount,
  CASE WHEN work_status = 'completed' THEN value ELSE 0.0 END AS expenditure, work_status,
  start_date, start_date + 365 AS expected_completion, actual_completion, images AS has_images,
  ida AS implementing_agency, value AS recommended_amount, 'real' AS source,
  {HOUSE} AS house, {SEAT} AS constituency
FROM judged WHERE reason IS NULL""", extra=RAW)
def loaded_works(t):
    accepted, _ = ingest.route_rejects(_united(t), t.p)
    return ingest.derive_works(accepted, t.p, ascii_only=True)


@query("clean_payments", "P9", f"""SELECT trim(p_brand) AS vendor, trim(ida) AS implementing_agency,
  {DISTRICT} AS district, round(paid::DECIMAL(24,8), 2)::DOUBLE AS expenditure_amount,
  ship_date AS expenditure_date, l_returnflag = 'R' AS unpaid, ls_term
FROM raw WHERE l_partkey % 31 <> 0 AND l_suppkey % 29 <> 0 AND l_partkey % 37 <> 0
  AND l_partkey % 41 <> 0 AND paid > 0""", extra=RAW)
def clean_payments(t):
    kept, _ = ingest.clean_payments(raw_fixtures.payments(t.spark, t.sf_dir, t.lines))
    return kept.select("vendor", "implementing_agency", "district", "expenditure_amount",
                       "expenditure_date", F.col("payment_status").isNull().alias("unpaid"),
                       "ls_term")


@query("payment_tally", "P9", """SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok)
  AS dropped FROM (SELECT l_partkey % 31 <> 0 AND l_suppkey % 29 <> 0 AND l_partkey % 37 <> 0
  AND l_partkey % 41 <> 0 AND paid > 0 AS ok FROM raw)""", extra=RAW)
def payment_tally(t):
    return ingest.clean_payments(raw_fixtures.payments(t.spark, t.sf_dir, t.lines))[1]


MEMBER_ID = """substr(sha1('customer ' || lpad(mp_id, 9, '0') || '|' || lower(state) || '|'
  || lower(house)), 1, 16)"""


@query("clean_members", "P10 P12 P13 S5 W3", f"""SELECT {MEMBER_ID} AS mp_id, ls_term, mp_name,
  allocated_amount::DOUBLE AS allocated_amount,
  CASE WHEN mp_id::INTEGER % 19 <> 0 THEN amount_recommended::DOUBLE END AS amount_recommended,
  unspent_amount::DOUBLE AS unspent_amount, completed_works,
  NULL::DOUBLE AS transaction_count FROM members WHERE mp_id::INTEGER % 71 <> 0""")
def clean_members(t):
    rows, _ = ingest.clean_members(raw_fixtures.member_summary(t.spark, t.sf_dir), "ordinal",
                                   ascii_only=True)
    return rows.select(
        "mp_id", "ls_term", "mp_name", "allocated_amount", "amount_recommended",
        "unspent_amount", "completed_works",
        F.col("transaction_count").cast("double").alias("transaction_count"))


@query("member_tally", "P10", """SELECT count(*) FILTER (n % 71 = 0)
  + count(*) FILTER (n % 71 = 0 AND n % 50 = 0) AS dropped,
  count(*) FILTER (n % 71 <> 0 AND n % 50 = 0) AS collapsed
FROM (SELECT mp_id::INTEGER AS n FROM members)""")
def member_tally(t):
    return ingest.clean_members(raw_fixtures.member_summary(t.spark, t.sf_dir), "ordinal",
                                ascii_only=True)[1]


@query("unkeyed_works", "P27", """SELECT count(*) FILTER (order_id % 9 = 0) AS unkeyed
FROM works""")
def unkeyed_works(t):
    lost = F.when(F.col("order_id") % 9 != 0, F.col("work_key"))
    return ingest.require_key(t.works.withColumn("work_key", lost))[1]


@query("duplicate_keys", "P3 P10", """SELECT work_key, count(*) AS rows FROM (
  SELECT concat_ws('|', order_id, ls_term, implementing_agency) AS work_key FROM works)
GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(t):
    short = ingest.work_key("order_id", "ls_term", "implementing_agency")
    return ingest.duplicate_keys(t.works.withColumn("work_key", short))


@query("parse_amounts", "P25", """SELECT work_key, amount FROM (SELECT work_key,
  CASE WHEN order_id % 5 = 0 THEN 0.0 ELSE sanctioned_amount::DOUBLE END AS amount FROM works)""")
def parse_amounts(t):
    shown = F.when(F.col("order_id") % 5 == 0, F.lit("₹ -")).otherwise(
        F.concat(F.lit("₹ "), F.format_number(F.col("sanctioned_amount"), 2)))
    return t.works.select("work_key", text.parse_amount(shown).alias("amount"))


# ----------------------------------------------------------------- CSV extracts


def _written(t, df, name: str, day: str, parts: int | None = None):
    """A dated extract in a folder of its own, as a download step would leave it."""
    folder = f"{shared_dir(t.spark)}/extracts-{uuid.uuid4().hex}"
    for when in ("2001-01-01", day):
        rows = df if when == day else df.limit(0)
        rows.write.csv(f"{folder}/works_{name}_{when}.csv", header=True, quoteAll=True,
                       escape='"')
    return folder


@query("read_extract", "S1 S2", """SELECT l_orderkey::VARCHAR AS "Work ID",
  p_name || ', phase ' || l_linenumber || chr(10) || '"' || p_type || '"' AS "Work Description",
  s_name AS "IDA" FROM joined""")
def read_extract(t):
    rows = fixtures._joined(t.spark, t.sf_dir).select(
        F.col("l_orderkey").cast("string").alias("Work ID"),
        F.concat(F.col("p_name"), F.lit(", phase "), F.col("l_linenumber").cast("string"),
                 F.lit('\n"'), F.col("p_type"), F.lit('"')).alias("Work Description"),
        F.col("s_name").alias("IDA"))
    folder = _written(t, rows, "recommended", "2001-08-01")
    schema = extracts.text_schema(rows.columns)
    found = extracts.read_extract(t.spark, folder, "recommended", schema)
    return found.drop(extracts.CORRUPT, "source_file")


@query("verify_extract", "S3 S4", """SELECT count(*) AS rows, 0::BIGINT AS malformed,
  true AS valid FROM works""")
def verify_extract(t):
    by_term = {term: t.works.filter(F.col("ls_term") == term).select("work_key", "description")
               for term in (17, 18)}
    merged = extracts.union_terms(by_term)
    return extracts.verify_extract(merged, [17, 18]).select("rows", "malformed", "valid")


@query("verify_broken_extract", "S4", """SELECT count(*) AS rows,
  count(*) FILTER (order_id % 10 = 0) AS malformed, false AS valid FROM works
WHERE ls_term = 18""")
def verify_broken_extract(t):
    lines = t.works.filter("ls_term = 18").select(F.concat(
        F.lit('"'), F.col("work_key"), F.lit('"'),
        F.when(F.col("order_id") % 10 == 0, F.lit("")).otherwise(F.lit(',"text"'))).alias("value"))
    folder = f"{shared_dir(t.spark)}/broken-{uuid.uuid4().hex}"
    lines.write.text(folder)
    schema = extracts.text_schema(["work_key", "description"])
    schema = schema.add(extracts.CORRUPT, "string")
    rows = t.spark.read.csv(folder, schema=schema, multiLine=True, escape='"',
                            columnNameOfCorruptRecord=extracts.CORRUPT)
    return extracts.verify_extract(rows.withColumn("ls_term", F.lit(18)), [17, 18]).select(
        "rows", "malformed", "valid")


@query("union_terms", "S3", """SELECT ls_term, count(*) AS rows, count(DISTINCT work_key) AS keys
FROM works GROUP BY 1""")
def union_terms(t):
    by_term = {term: t.works.filter(F.col("ls_term") == term).select("work_key")
               for term in (17, 18)}
    return extracts.union_terms(by_term).groupBy("ls_term").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("work_key").alias("keys"))


# ------------------------------------------------------------------ publishing


@query("published_profile", "S6", "SELECT * FROM profile")
def published_profile(t):
    root = f"{shared_dir(t.spark)}/published-{uuid.uuid4().hex}"
    publish.publish(t.profile.limit(0), root, "profile")
    publish.publish(t.profile, root, "profile")
    return publish.read_published(t.spark, root, "profile")


@query("change_only_write", "M8 S6 S8", """SELECT true AS first_write, false AS same_again,
  true AS after_change""")
def change_only_write(t):
    root = f"{shared_dir(t.spark)}/changes-{uuid.uuid4().hex}"
    changed = t.profile.withColumn("total_spend", F.col("total_spend") + 0.01)
    writes = [publish.publish_if_changed(df, root, "profile")
              for df in (t.profile, t.profile.orderBy("total_spend"), changed)]
    return t.profile.agg(F.count(F.lit(1))).select(
        *[F.lit(w).alias(n) for w, n in zip(writes, ("first_write", "same_again", "after_change"))])


@query("republished_works", "S6 S8 M8", """SELECT work_key, description, ls_term,
  sanctioned_amount::DOUBLE + CASE WHEN order_id = 7 THEN 1 ELSE 0 END AS sanctioned_amount
FROM works WHERE order_id % 50 <> 3""")
def republished_works(t):
    root = f"{shared_dir(t.spark)}/slots-{uuid.uuid4().hex}"
    first = t.works.select("order_id", "work_key", "description", "ls_term",
                           F.col("sanctioned_amount").cast("double").alias("sanctioned_amount"))
    amount = F.col("sanctioned_amount") + F.when(F.col("order_id") == 7, 1).otherwise(0)
    second = first.withColumn("sanctioned_amount", amount)
    for df in (first, second, second.filter("order_id % 50 <> 3")):
        publish.publish_slots(df, root, "works", ["work_key"])
    return publish.read_slots(t.spark, root, "works").drop("order_id")


@query("slot_prints", "S8 M8", """SELECT count(*) AS rows,
  sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS sum_a,
  bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS xor_b
FROM (SELECT md5(concat_ws(chr(31), '=' || order_id, '=' || work_key)) AS h FROM works)""")
def slot_prints(t):
    # The hash that deals rows to slots is Spark's own; the prints of all slots add up.
    prints = publish.slot_prints(t.works.select("order_id", "work_key"), ["work_key"])
    return prints.agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("sum_a").cast("decimal(38,0)")).cast("string").alias("sum_a"),
        F.bit_xor("xor_b").alias("xor_b"))


@query("merged_works", "P4 P10", """SELECT work_key, description, ls_term,
  sanctioned_amount::DOUBLE + CASE WHEN order_id % 10 = 3 THEN 2 ELSE 0 END AS sanctioned_amount,
  CASE WHEN order_id % 10 IN (3, 4) THEN 2 ELSE 0 END AS day
FROM works""")
def merged_works(t):
    rows = t.works.select("order_id", "work_key", "description", "ls_term",
                          F.col("sanctioned_amount").cast("double").alias("sanctioned_amount"))
    # Orders ending in 4 are new that day, those in 3 changed and met twice in its extract.
    stored = store.create(rows.filter("order_id % 10 <> 4").select("*", F.lit(0).alias("day")),
                          "work_key", 16)
    changed = rows.filter("order_id % 10 = 3")
    more = F.col("sanctioned_amount")
    day = (rows.filter("order_id % 10 = 4").withColumn("day", F.lit(2))
           .unionByName(changed.withColumns({"sanctioned_amount": more + 1, "day": F.lit(1)}))
           .unionByName(changed.withColumns({"sanctioned_amount": more + 2, "day": F.lit(2)})))
    return store.merge(t.spark, stored, day, "day").rows(t.spark).drop("order_id")


@query("drop_orphans", "S7", """SELECT work_key, overall_risk_score FROM scored
WHERE order_id % 4 <> 0""")
def drop_orphans(t):
    kept = t.works.filter(F.col("order_id") % 4 != 0)
    found = publish.drop_orphans(t.scores_by_order, kept, ("order_id",))
    # Written here: both lie by order and are joined without being moved.
    with joined_in_place(t.spark):
        return cut(found.select("work_key", "overall_risk_score"), "kept-scores")


_CELL = "coalesce('=' || {0}, '~')"


@query("fingerprint", "S8", """SELECT 'works' AS frame, count(*) AS rows,
  sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS sum_a,
  bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS xor_b
FROM (SELECT md5(concat_ws(chr(31), """ + ", ".join(
    _CELL.format(c) for c in ("actual_completion::VARCHAR", "sanctioned_amount::VARCHAR",
                              "work_key")) + ")) AS h FROM works)")
def fingerprint(t):
    return publish.fingerprint(works=t.works.select(
        "work_key", "sanctioned_amount", "actual_completion"))


RUNS = """runs AS (SELECT event_id AS run_id, CASE event_type WHEN 'signup' THEN 'running'
    WHEN 'error' THEN 'failed' ELSE 'success' END AS status, ts AS started_at,
  CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 30 MINUTE END AS finished_at,
  CASE WHEN event_type <> 'error' THEN user_id * 100 END AS rows_loaded,
  CASE WHEN event_type = 'view' THEN 'unchanged' END AS notes FROM events)"""
NOW = dt.datetime(2024, 1, 31)


def _runs(t):
    """A run log of two records per finished run: one at its start, one at its end."""
    kind = F.col("event_type")
    log = t.raw("events").select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(kind == "signup", "running").when(kind == "error", "failed")
        .otherwise("success").alias("status"),
        F.when(kind != "error", F.col("user_id") * 100).alias("rows_loaded"),
        F.when(kind == "view", "unchanged").alias("notes"))
    nothing = F.lit(None)
    opened = log.withColumns({
        "status": F.lit("running"), "finished_at": nothing.cast("timestamp"),
        "logged_at": F.col("started_at"), "rows_loaded": nothing.cast("bigint"),
        "notes": nothing.cast("string")})
    half_hour = F.make_dt_interval(mins=F.lit(30))
    closed = log.filter("status <> 'running'").withColumn(
        "finished_at", F.col("started_at") + half_hour).withColumn(
        "logged_at", F.col("finished_at"))
    still = log.filter("status = 'running'").withColumn(
        "finished_at", nothing.cast("timestamp")).withColumn(
        "logged_at", F.col("started_at") + half_hour)
    return publish.current_runs(opened.unionByName(closed).unionByName(still))


_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"


@query("latest_success", "S11", f"""SELECT run_id, {_STAMP.format("finished_at")}, rows_loaded
FROM runs WHERE status = 'success' ORDER BY runs.finished_at DESC NULLS LAST, run_id DESC
LIMIT 1""", extra=RUNS)
def latest_success(t):
    return publish.latest_success(_runs(t)).select("run_id", "finished_at", "rows_loaded")


@query("close_abandoned", "S11", """SELECT CASE status WHEN 'running' THEN 'failed' ELSE status END
  AS status, CASE WHEN status = 'running' THEN concat_ws(' | ', notes,
    'abandoned: never finished, closed by a later run') ELSE notes END AS notes,
  count(*) AS runs, strftime(max(CASE WHEN status = 'running' THEN TIMESTAMP '2024-01-31 00:00:00'
    ELSE finished_at END), '%Y-%m-%d %H:%M:%S.%f') AS last_finish
FROM runs GROUP BY 1, 2""", extra=RUNS)
def close_abandoned(t):
    return publish.close_abandoned(_runs(t), NOW).groupBy("status", "notes").agg(
        F.count(F.lit(1)).alias("runs"), F.max("finished_at").alias("last_finish"))


@query("adoptable_run", "S11", """SELECT run_id FROM runs WHERE status = 'running'
  AND started_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 12 HOUR
ORDER BY started_at DESC, run_id DESC LIMIT 1""", extra=RUNS)
def adoptable_run(t):
    return publish.adoptable_run(_runs(t), NOW).select("run_id")


# ------------------------------------------------------------------------ text


@query("normalize_documents", "P11", r"""SELECT doc_id, length(n) AS chars, md5(n) AS digest
FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(replace(replace(text, 'ß', 'ss'),
  'ẞ', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents)""", bare=True)
def normalize_documents(t):
    norm = text.normalize_text("text")
    return t.raw("documents").select("doc_id", norm.alias("n")).select(
        "doc_id", F.length("n").cast("bigint").alias("chars"), F.md5("n").alias("digest"))


PHRASES = [k for _, words in text.SECTOR_RULES for k in words]
_LIST = "[" + ", ".join(f"'{k}'" for k in PHRASES) + "]"
PHRASED = f"""phrased AS (SELECT work_key, 'Nirman of ' || ({_LIST})[order_id % {len(PHRASES)} + 1]
  || CASE WHEN order_id % 2 = 0 THEN 's' ELSE '' END || ' - ' || description AS description
  FROM works), normed AS (SELECT *, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'))
  AS n FROM phrased)"""
_CASES = " ".join(
    f"WHEN regexp_matches(n, '\\b(?:{'|'.join(words)})(?:e?s)?\\b') THEN '{sector}'"
    for sector, words in text.SECTOR_RULES)


def _phrased(t):
    words = F.array(*[F.lit(k) for k in PHRASES])
    word = F.element_at(words, (F.col("order_id") % len(PHRASES) + 1).cast("int"))
    plural = F.when(F.col("order_id") % 2 == 0, "s").otherwise("")
    return t.works.withColumn("description", F.concat(
        F.lit("Nirman of "), word, plural, F.lit(" - "), F.col("description")))


@query("classify_sectors", "P14", f"""SELECT work_key, CASE {_CASES} ELSE 'Other' END AS sector
FROM normed""", extra=PHRASED)
def classify_sectors(t):
    return _phrased(t).select("work_key", text.classify("description", ascii_only=True)
                              .alias("sector"))


@query("stratifier_guard", "P15", f"""SELECT count(*) AS works, count(*) FILTER (sector = 'Other')
  AS other, count(*) FILTER (sector = 'Other') > 0.4 * count(*) AS too_many
FROM (SELECT CASE {_CASES} ELSE 'Other' END AS sector FROM normed)""", extra=PHRASED)
def stratifier_guard(t):
    placed = _phrased(t).withColumn("sector", text.classify("description", ascii_only=True))
    return labels.check_stratifier(placed)


# The first four fixture rules place half of the works; a cache answers for some of the rest.
HALF_RULES = fixtures.PART_RULES[:4]
CACHED = """half AS (SELECT work_key, description, CASE WHEN sector IN ('Anvils', 'Bolts', 'Gears',
    'Gizmos') THEN sector ELSE 'Other' END AS rule,
  CASE WHEN description LIKE '%economy' THEN 'Cheap' WHEN description LIKE '%promo' THEN 'Other'
    END AS cached FROM works)"""


def _cache(t):
    return t.works.filter("description like '%economy' or description like '%promo'").select(
        text.normalize_text("description", True).alias("text"),
        F.when(F.col("description").endswith("economy"), "Cheap").otherwise("Other")
        .alias("label")).distinct()


@query("fill_labels", "P16", """SELECT work_key, CASE WHEN rule <> 'Other' THEN rule
  ELSE coalesce(cached, 'Other') END AS sector FROM half""", extra=CACHED)
def fill_labels(t):
    return labels.fill_labels(t.works, _cache(t), HALF_RULES, True).select("work_key", "sector")


@query("unlabelled_worklist", "P17 J11", """SELECT description, count(*) AS works FROM half
WHERE rule = 'Other' AND cached IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", extra=CACHED)
def unlabelled_worklist(t):
    return labels.unlabelled(t.works, _cache(t), 50, HALF_RULES, True).drop("text")


def _stub_labeller(texts):
    return ["Rods" if "rod" in x else "Spaceships" if "ring" in x else "Plates" for x in texts]


@query("label_batches", "P18", """SELECT DISTINCT description AS text, CASE
  WHEN contains(description, 'rod') THEN 'Rods' WHEN contains(description, 'ring') THEN 'Other'
  ELSE 'Plates' END AS label FROM half WHERE rule = 'Other' AND cached IS NULL""", extra=CACHED)
def label_batches(t):
    """Given every description: what the rules or the cache place is not asked again."""
    return labels.label_batches(t.works.select("description"), _stub_labeller, ["Rods", "Plates"],
                                ascii_only=True, cache=_cache(t), rules=HALF_RULES)


DRESSED = """dressed AS (SELECT mp_id, ls_term, CASE mp_id::INTEGER % 4
  WHEN 0 THEN 'Shri ' || mp_name || '(17th Lok Sabha)' WHEN 1 THEN 'Smt. A. ' || mp_name
    || ' (2022-28)' WHEN 2 THEN mp_name || ' (17LS)EX' ELSE 'Dr. (Dev) ' || mp_name END AS written,
  state, house, mp_name FROM members)"""


def _dressed(t):
    n = F.col("mp_id").cast("int") % 4
    name = F.col("mp_name")
    written = (
        F.when(n == 0, F.concat(F.lit("Shri "), name, F.lit("(17th Lok Sabha)")))
        .when(n == 1, F.concat(F.lit("Smt. A. "), name, F.lit(" (2022-28)")))
        .when(n == 2, F.concat(name, F.lit(" (17LS)EX")))
        .otherwise(F.concat(F.lit("Dr. (Dev) "), name)))
    return t.members.withColumn("written", written)


@query("person_names", "P12 P13", r"""SELECT mp_id, ls_term, person,
  substr(sha1(person || '|' || lower(state) || '|' || lower(house)), 1, 16) AS key
FROM (SELECT *, 'customer ' || lpad(mp_id, 9, '0') AS base, CASE mp_id::INTEGER % 4
  WHEN 2 THEN base || ' ex' WHEN 3 THEN 'dev ' || base ELSE base END AS person FROM dressed)""",
       extra=DRESSED)
def person_names(t):
    return _dressed(t).select(
        "mp_id", "ls_term", text.normalize_person("written", True).alias("person"),
        text.member_key("written", "state", "house", True).alias("key"))


@query("clean_names", "P19", r"""SELECT mp_id, ls_term, coalesce(nullif(trim(regexp_replace(written,
  '\s*\([^()]*\)\s*[A-Za-z]*\s*$', '')), ''), written) AS name FROM dressed""", extra=DRESSED)
def clean_names(t):
    return _dressed(t).select("mp_id", "ls_term", text.clean_name("written").alias("name"))


@query("seats", "P21", """SELECT mp_id, ls_term, CASE WHEN house <> 'Rajya Sabha' THEN constituency
  WHEN constituency LIKE 'Nominated%' THEN 'Nominated' END AS seat FROM members""")
def seats(t):
    return t.members.select("mp_id", "ls_term", text.seat("constituency", "house").alias("seat"))


# ---------------------------------------------------------------- reconciliation

TOTALS = """ours AS (
  SELECT 'Allocated' AS metric, sum(allocated_amount)::DOUBLE / 1e7 AS value, 'crore' AS unit
    FROM members WHERE ls_term = 18
  UNION ALL SELECT 'Expenditure', sum(total_expenditure)::DOUBLE / 1e7, 'crore' FROM members
    WHERE ls_term = 18
  UNION ALL SELECT 'Works in pipeline', count(*)::DOUBLE, 'count' FROM works WHERE ls_term = 18
  UNION ALL SELECT 'Works completed', (count(*) FILTER (work_status = 'completed'))::DOUBLE,
    'count' FROM works WHERE ls_term = 18
  UNION ALL SELECT 'Completed value', (sum(expenditure) FILTER (work_status = 'completed'))::DOUBLE
    / 1e7, 'crore' FROM works WHERE ls_term = 18
), official AS (SELECT metric, value * 1.04::DOUBLE AS value FROM ours WHERE metric <> 'Expenditure'
), aggregator AS (SELECT metric, value * 1.01::DOUBLE AS value FROM ours
  WHERE metric <> 'Completed value'
), gaps AS (SELECT o.metric, o.value AS a, f.value AS b, g.value AS c, unit FROM ours o
  LEFT JOIN official f USING (metric) LEFT JOIN aggregator g USING (metric)
), reconciled AS (SELECT metric, """ + f"""{r("a", 2)} AS ours, {r("b", 2)} AS official, unit,
  {r("(a - b) / b * 100", 2)} AS gap_pct, {r("c", 2)} AS aggregator,
  {r("(c - b) / b * 100", 2)} AS aggregator_gap_pct FROM gaps)"""


def _reconciled(t):
    ours = reconcile.our_totals(t.works, t.members, 18)
    official = ours.filter("metric <> 'Expenditure'").withColumn("value", F.col("value") * 1.04)
    other = ours.filter("metric <> 'Completed value'").withColumn("value", F.col("value") * 1.01)
    return reconcile.reconcile(ours, official, other)


@query("our_totals", "A32", f"SELECT metric, {r('value', 4)} AS value, unit FROM ours",
       extra=TOTALS.replace("gaps AS", "gapped AS").replace("FROM gaps)", "FROM gapped)"))
def our_totals(t):
    return reconcile.our_totals(t.works, t.members, 18).withColumn(
        "value", F.round(F.col("value").cast("decimal(24,8)"), 4).cast("double"))


@query("reconciliation", "J16 A31", "SELECT * FROM reconciled",
       extra=TOTALS.replace("gaps AS", "gapped AS").replace("FROM gaps)", "FROM gapped)"))
def reconciliation(t):
    return _reconciled(t)


@query("worst_hops", "A31", f"""SELECT max(abs(gap_pct)) AS worst_gap_pct,
  {r("max(abs(ours - aggregator) / aggregator * 100)", 4)} AS worst_our_hop_pct,
  max(abs(aggregator_gap_pct)) AS worst_upstream_hop_pct FROM reconciled""",
       extra=TOTALS.replace("gaps AS", "gapped AS").replace("FROM gaps)", "FROM gapped)"))
def worst_hops(t):
    return reconcile.worst_hops(_reconciled(t))


# --------------------------------------------------------------------- synthetic


def _drawn(salt: str) -> str:
    return (f"(('0x' || substr(md5('42:{salt}:' || id), 1, 13))::BIGINT::DOUBLE "
            f"/ {16 ** 13}.0::DOUBLE)")


@query("synthetic_works", "S12", f"""SELECT planted, count(*) AS works,
  sum(sanctioned_amount)::DOUBLE AS sanctioned FROM (
  SELECT planted, round((CASE WHEN planted = 'cost' THEN base * (2.2::DOUBLE + {_drawn("amount")}
      * 0.8::DOUBLE) ELSE base * (0.85::DOUBLE + {_drawn("amount")} * 0.3::DOUBLE) END)
      ::DECIMAL(24,8), 2)::DECIMAL(14,2) AS sanctioned_amount,
    unnest(CASE WHEN planted = 'duplicate' THEN [1, 2] ELSE [1] END) AS phase
  FROM (SELECT id, CASE WHEN f < 0.03 THEN 'cost' WHEN f < 0.08 THEN 'delay'
      WHEN f < 0.12 THEN 'agency' WHEN f < 0.1234 THEN 'duplicate' ELSE 'none' END AS planted,
    ([800000.0, 1500000.0, 600000.0, 900000.0, 300000.0, 1200000.0])
      [floor({_drawn("category")} * 6)::INTEGER + 1]::DOUBLE AS base
  FROM (SELECT o_orderkey AS id, ('0x' || substr(md5('42:fate:' || o_orderkey), 1, 13))::BIGINT
    ::DOUBLE / {16 ** 13}.0::DOUBLE AS f FROM orders))) GROUP BY 1""", bare=True)
def synthetic_works(t):
    made = synthetic.synthetic_works(t.raw("orders"), "o_orderkey")
    return made.groupBy("planted").agg(
        F.count(F.lit(1)).alias("works"), F.sum("sanctioned_amount").alias("sanctioned"))


@query("planted_recall", "S12 A2 A3")
def planted_recall(t):
    """Scores of synthetic works by what was planted in them."""
    made = cut(synthetic.synthetic_works(t.raw("orders"), "o_orderkey"), "synthetic").withColumns({
        "ls_term": F.lit(0), "has_images": F.lit(True),
        "sector": text.classify("description", ascii_only=True)})
    frame = scoring.timed(made, t.p)
    frame = peers.attach_delay_rate(peers.peer_baseline(frame))
    return frame.groupBy("planted").agg(
        F.count(F.lit(1)).alias("works"),
        F.round(F.avg("cost_deviation_pct"), 1).alias("mean_deviation"),
        F.round(F.avg("delay_days"), 1).alias("mean_delay"),
        F.round(F.avg("agency_delay_rate"), 1).alias("mean_agency_rate"))
