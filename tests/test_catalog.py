"""Every registered query against its check SQL, and the invariants between queries."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from worklens.catalog import REGISTRY  # noqa: E402
from worklens.catalog.tables import Tables  # noqa: E402
from worklens.plans import desks, queue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_equals_its_check(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert check.compare(got, want) == ""


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry_runs(spark):
    # 6,000 lines, of which two carry the same key.
    assert entry.entry(spark).count() == 5999


def test_overview_and_queue_count_the_same_works(t):
    flagged = desks.overview(t.scored, t.payments, t.members).first()["anomaly_count"]
    assert flagged == queue.queue_total(t.scored, t.verdicts, **queue.queue_scope()).first()["total"]
    assert flagged == queue.queue_summary(t.scored, t.verdicts).first()["in_scope"]


def test_districts_sum_to_their_state(t):
    desk = desks.state_desk(t.members, t.scored, t.works, t.findings, "ASIA", 18)
    whole = desk["works"].first()
    parts = desk["districts"].agg(*[F.sum(c).alias(c) for c in (
        "works", "completed", "high_risk", "in_queue")]).first()
    for c in ("works", "completed", "high_risk", "in_queue"):
        assert (parts[c] or 0) == whole[c]


def test_tiles_split_the_scope(t):
    row = queue.queue_summary(t.scored, t.verdicts, min_score=0).first()
    assert row["in_scope"] == (row["pending"] + row["verified"] + row["dismissed"]
                               + row["escalated"])


def test_export_has_one_line_per_work(spark, t, tmp_path):
    rows = queue.export_queue(t.scored, t.verdicts, min_score=90)
    queue.write_export(rows, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).count()
    assert lines == rows.count() + 1


def test_compliance_filter_equals_the_rule_book(t):
    breaching = desks.compliance_totals(t.scored, t.p).first()["works_breaching"]
    assert breaching == queue.queue_total(t.scored, t.verdicts, compliance="breach").first()["total"]


def test_forecast_is_a_part_of_what_is_due(t):
    row = desks.late_forecast(t.scored, t.p)[0].first()
    assert 0 <= row["likely_late"] <= row["due_in_window"]
