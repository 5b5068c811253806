import datetime as dt

import pytest
from pyspark.sql import functions as F

from worklens.functions import numeric, risk, text
from worklens.operators import ingest
from worklens.params import Params

P = Params(as_of=dt.date(2026, 1, 1))


@pytest.mark.parametrize("x,expected", [(None, 0), (10, 0), (30, 100), (20, 50), (99, 100)])
def test_ramp(value, x, expected):
    assert value(numeric.ramp("x", 10, 30), "x double", x=None if x is None else float(x)) == expected


@pytest.mark.parametrize("day,label", [
    ("2024-03-31", "2023-24"), ("2024-04-01", "2024-25"), ("2024-12-31", "2024-25"),
    ("1999-05-01", "1999-100")])
def test_fiscal_year_starts_in_april(value, day, label):
    assert value(numeric.fiscal_year(F.to_date("x")), x=day) == label


@pytest.mark.parametrize("x,digit", [
    (1.0, 1), (19.0, 1), (250.0, 2), (9999.0, 9), (0.4, None), (None, None), (-37.0, 3),
    (1000.0, 1), (999.99, 9), (100000.0, 1)])
def test_first_digit(value, x, digit):
    assert value(numeric.first_digit("x"), "x double", x=x) == digit


def test_rounding_is_half_up(value):
    assert value(numeric.rounded("x", 2), "x double", x=2.345) == 2.35


def test_rates_need_a_positive_denominator(value):
    assert value(numeric.safe_rate(F.lit(5), "x"), "x int", x=0) is None
    assert value(numeric.safe_rate(F.lit(5), "x"), "x int", x=40) == 12.5
    assert value(numeric.share_of(F.lit(0), "x"), "x int", x=0) == 0


@pytest.mark.parametrize("share,index", [(0.0, 0), (4.9, 0), (5.0, 1), (34.9, 3), (35.0, 4),
                                         (None, None)])
def test_share_bins(value, share, index):
    assert value(numeric.share_bin("x"), "x double", x=share) == index


# ------------------------------------------------------------------------ text


def test_patterns_are_tried_on_texts_that_hold_a_keyword(spark):
    rules = [("Lights", ["light", "mast"])]
    one = spark.createDataFrame([("Lightship",), ("two masts",), ("",)], "x string")
    plan = one.select(text.classify("x", rules))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Contains(") == 2
    found = one.select(text.classify("x", rules).alias("s")).collect()
    assert [r["s"] for r in found] == ["Other", "Lights", "Other"]


@pytest.mark.parametrize("phrase,sector", [
    ("Twelve new lights by the bus stop", "Street Lighting"),
    ("Culverts under the old highway", "Roads & Paving"),
    ("Footpath beside a drain", "Roads & Paving"),
    ("Septic tank for a market", "Drainage & Sanitation"),
    ("Toilets at the fairground", "Drainage & Sanitation"),
    ("New roof, panchayat ghar", "Community Buildings"),
    ("Overhead tank with two pumps", "Water"),
    ("Classrooms and a fence", "Education"),
    ("Forty computers", "Equipment & Vehicles"),
    ("Steps of the ghat", "Religious & Cultural"),
    ("Vehicles for the ward", "Equipment & Vehicles"),
    ("zzz qqq", "Other"), ("", "Other"), (None, "Other")])
def test_sectors(value, phrase, sector):
    assert value(text.classify("x"), x=phrase) == sector


@pytest.mark.parametrize("raw,norm", [
    ("  Road,  PHASE 2. ", "road phase 2"), ("Émile Ölçer", "emile olcer"),
    ("Straße ½", "strasse 1 2"), ("ﬁne　①", "fine 1"), (None, ""), ("नाली road", "road")])
def test_normalize_text(value, raw, norm):
    assert value(text.normalize_text("x"), x=raw) == norm


def _key():
    return text.member_key("n", "s", "h")


SCHEMA = "n string, s string, h string"


def test_one_member_written_in_many_ways_has_one_key(value):
    key = lambda name: value(_key(), SCHEMA, n=name, s="Telangana", h="Lok Sabha")
    same = {key(n) for n in (
        "Manne Srinivas Reddy(17th Lok Sabha)", "Shri Manne Srinivas Reddy (17th Lok Sabha)",
        "Manne Srinivas Reddy", "MANNE SRINIVAS REDDY (17LS)", "M. Manne Srinivas Reddy (2025-31)")}
    assert len(same) == 1
    assert key("Kalyan (Banerjee)") != key("Kalyan")


def test_state_and_house_separate_namesakes(value):
    keys = {value(_key(), SCHEMA, n="Ram Kumar", s=s, h=h)
            for s, h in (("Bihar", "Lok Sabha"), ("Odisha", "Lok Sabha"), ("Bihar", "Rajya Sabha"))}
    assert len(keys) == 3


@pytest.mark.parametrize("name", ["", None, "   ", "Shri", "Dr."])
def test_a_name_without_text_has_no_key(value, name):
    assert value(_key(), SCHEMA, n=name, s="Bihar", h="Lok Sabha") is None


@pytest.mark.parametrize("raw,key", [
    ("NCT of Delhi", "delhi"), ("The Dadra & Nagar Haveli and Daman and Diu",
                                "dadra and nagar haveli"),
    ("Keralam", "kerala"), ("  Tamil   Nadu ", "tamil nadu"), (None, "")])
def test_state_key(value, raw, key):
    assert value(text.state_key("x"), x=raw) == key


@pytest.mark.parametrize("raw,clean", [
    ("Some Name(17th Lok Sabha)", "Some Name"), ("Some Name (17LS)EX", "Some Name"),
    ("(2020-26)", "(2020-26)"), ("Kalyan (Dev) Roy Sen", "Kalyan (Dev) Roy Sen")])
def test_clean_name(value, raw, clean):
    assert value(text.clean_name("x"), x=raw) == clean


@pytest.mark.parametrize("raw,amount", [("₹83,33,66.01", 833366.01), ("", 0.0), (None, 0.0)])
def test_parse_amount(value, raw, amount):
    assert value(text.parse_amount("x"), x=raw) == amount


def test_search_text_is_taken_literally(value):
    assert value(text.contains_text("x", "100%"), x="about 100% done") is True
    assert value(text.contains_text("x", "%"), x="plain") is False
    assert value(text.contains_text("x", "A"), x=None) is False


@pytest.mark.parametrize("name,rank", [("road to", 0), ("the road", 1), ("broad", 2), ("hall", 3)])
def test_text_rank(value, name, rank):
    assert value(text.text_rank("x", "ROAD"), x=name) == rank


def test_term_years(value):
    assert tuple(value(text.term_years("x"), x="Smt. A (2024-30)")) == (2024, 2030)
    assert tuple(value(text.term_years("x"), x="2024 - 2030")) == (2024, 2030)
    assert value(text.term_years("x"), x="none") is None


# ---------------------------------------------------------------------- ingest


@pytest.mark.parametrize("ida,district", [
    ("CHITTOOR(DISTRICT COLLECTOR)", "CHITTOOR"), (" pune ", "PUNE"), ("(only)", "(ONLY)")])
def test_district(value, ida, district):
    assert value(ingest.district("x"), x=ida) == district


@pytest.mark.parametrize("raw,day", [
    ("2024-02-29", dt.date(2024, 2, 29)), ("2024-02-30", None), ("yesterday", None),
    ("2024-02-29T23:30:00Z", dt.date(2024, 2, 29)), (None, None), ("2024", None)])
def test_iso_date(value, raw, day):
    assert value(ingest.iso_date("x"), x=raw) == day


def test_unknown_is_not_false(value):
    assert [value(ingest.tri_bool("x"), x=x) for x in ("True", "False", "maybe", None)] == [
        True, False, None, None]


def test_work_key_separates_agencies(value):
    key = ingest.work_key(F.lit(241), F.lit(17), "x")
    assert value(key, x=" KHORDHA(DC) ") == "241|17|KHORDHA(DC)"


# ------------------------------------------------------------------------ risk


def test_component_scores(value):
    assert value(risk.cost_risk("x", F.lit(8)), "x double", x=250.0) == 100.0
    assert value(risk.cost_risk("x", F.lit(7)), "x double", x=250.0) == 0.0
    assert value(risk.cost_risk("x", F.lit(8)), "x double", x=-20.0) == 0.0
    assert value(risk.delay_risk("x"), "x int", x=90) == 50.0
    assert value(risk.duplicate_risk("x"), "x double", x=0.9399) == 0.0
    assert value(risk.duplicate_risk("x"), "x double", x=0.97) == pytest.approx(50.0)
    assert value(risk.concentration_risk("x", F.lit(2), P), "x double", x=1.0) == 0.0
    assert value(risk.concentration_risk("x", F.lit(20), P), "x double", x=1.0) == 100.0
    assert value(risk.pending_risk("x", P), "x int", x=None) == 0.0
    assert value(risk.pending_risk("x", P), "x int", x=410) == 50.0


def test_agency_risk_is_the_worst_signal(value):
    assert value(risk.agency_risk("x", F.lit(20.0), F.lit(10), P), "x double", x=70.0) == 70.0
    assert value(risk.agency_risk("x", F.lit(80.0), F.lit(10), P), "x double", x=None) == 80.0
    assert value(risk.agency_risk("x", F.lit(None).cast("double"), F.lit(5000), P),
                 "x double", x=None) == 100.0


@pytest.mark.parametrize("score,band", [(39.99, "LOW"), (40.0, "MEDIUM"), (69.99, "MEDIUM"),
                                        (70.0, "HIGH"), (None, None)])
def test_bands(value, score, band):
    assert value(risk.risk_level("x"), "x double", x=score) == band


WORK = ("expenditure double, sanctioned_amount double, work_status string, start_date date, "
        "expected_completion date, actual_completion date, has_images boolean")
DAY = dt.date(2024, 6, 1)


@pytest.mark.parametrize("row,score,count", [
    (dict(expenditure=0.0, work_status="recommended"), 20.0, 1),
    (dict(expenditure=100.0, work_status="completed", actual_completion=DAY), 0.0, 0),
    (dict(expenditure=100.0, work_status="completed", actual_completion=DAY, has_images=False),
     30.0, 1),
    (dict(expenditure=100.0, work_status="completed", actual_completion=DAY, has_images=True),
     0.0, 0),
    (dict(expenditure=0.0, work_status="recommended", start_date=DAY, expected_completion=DAY,
          has_images=False), 0.0, 0),
    (dict(expenditure=150.0, work_status="completed", has_images=False), 100.0, 3),
])
def test_compliance(value, row, score, count):
    row = dict(sanctioned_amount=100.0, **row)
    assert value(risk.compliance_risk(), WORK, **row) == score
    assert len(value(risk.compliance_reasons(), WORK, **row)) == count


PRICED = ("compliance_reasons array<string>, sanctioned_amount double, peer_median_cost double, "
          "peer_count int, district string, sector string, cost_deviation_pct double, "
          "iso_anomaly double, delay_risk double, delay_days int, duplicate_risk double, "
          "max_similarity_score double, agency_risk double, agency_delay_rate double, "
          "agency_concentration_risk double, agency_oldest_pending_days int, "
          "agency_pending_count int, agency_top_vendor string, agency_top_vendor_share_pct double, "
          "agency_total_spend double, agency_vendor_count int, agency_transaction_count int")
CLEAN = dict(compliance_reasons=[], sanctioned_amount=1_400_000.0, peer_median_cost=1_000_000.0,
             peer_count=12, district="PUNE", sector="Water", cost_deviation_pct=0.0,
             iso_anomaly=0.0, delay_risk=0.0, delay_days=0, duplicate_risk=0.0,
             max_similarity_score=0.0, agency_risk=0.0)


def _reasons(value, **changes):
    return value(risk.flag_reasons(P), PRICED, **{**CLEAN, **changes})


def test_cost_reason_states_its_basis(value):
    assert _reasons(value, cost_deviation_pct=41.0) == [
        "₹1,400,000 against a ₹1,000,000 median for Water works in PUNE "
        "(41% above, 12 peer works)"]


def test_cost_reason_needs_its_basis(value):
    assert _reasons(value, cost_deviation_pct=80.0, peer_count=3) == []
    assert _reasons(value, cost_deviation_pct=80.0, peer_median_cost=None) == []
    # A forest score is told only where the cost sentence is not.
    told = _reasons(value, cost_deviation_pct=80.0, peer_count=3, iso_anomaly=60.0)
    assert told == [risk.FOREST_REASON]
    assert len(_reasons(value, cost_deviation_pct=80.0, iso_anomaly=60.0)) == 1


def test_agency_reason_names_its_driver(value):
    vendor = dict(agency_top_vendor="Acme", agency_top_vendor_share_pct=74.0,
                  agency_total_spend=12_500_000.0, agency_vendor_count=9,
                  agency_transaction_count=140)
    assert _reasons(value, agency_risk=70.0, agency_delay_rate=70.0) == [
        "Implementing agency has a 70% delay rate across its projects"]
    assert _reasons(value, agency_risk=80.0, agency_concentration_risk=80.0, **vendor) == [
        "74% of this agency's ₹12,500,000 spend went to one vendor (Acme), across 9 vendors "
        "and 140 transactions"]
    assert _reasons(value, agency_risk=100.0, agency_oldest_pending_days=900,
                    agency_pending_count=1) == ["1 payment still in progress, oldest 900 days"]


def test_reasons_keep_their_order(value):
    told = _reasons(value, compliance_reasons=["first"], cost_deviation_pct=50.0, delay_risk=50.0,
                    delay_days=90, duplicate_risk=50.0, max_similarity_score=0.97)
    assert [told[0], told[2], told[3]] == [
        "first", "90 days beyond expected completion", "97% similarity with another nearby work"]
