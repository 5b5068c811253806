"""Lines, works and scores lie by order: they are joined and grouped without moving whole rows."""

import re

import pytest
from pyspark.sql import functions as F

from worklens.catalog.tables import Tables
from worklens.operators import ingest, ledger, peers
from worklens.plans import queue, scoring
from worklens.session import IN_PLACE_KEY, cut, cut_by, joined_in_place
from worklens.sources import fixtures, publish

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Tables(spark, SF)


def moved(df) -> list[str]:
    """The columns of each exchange in the plan, broadcasts left out."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


def same(left, right) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_views_of_dealt_lines_are_those_of_the_join(spark, t):
    assert same(fixtures.works(spark, SF, t.lines), fixtures.works(spark, SF))
    assert same(t.payments, fixtures.payments(spark, SF))
    assert same(t.review_events, fixtures.review_events(spark, SF))


def test_payments_are_read_from_the_lines_and_not_written_again(t):
    assert sorted(t.payments.inputFiles()) == sorted(t.lines.inputFiles())
    assert moved(t.payments) == []


def test_repeated_keys_are_found_where_they_lie(spark, t):
    seen = fixtures.works(spark, SF, t.lines)
    once = ingest.one_per_key(seen, "work_key", ("order_id",))
    assert moved(once) == []
    assert same(once, ingest.one_per_key(fixtures.works(spark, SF), "work_key"))
    assert seen.count() == 6000 and once.count() == 5999


def test_scoring_and_the_view_move_no_whole_row(t):
    # Tables of this size would be broadcast; larger ones are not.
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(t.spark):
            view = scoring.scored_view(t.works, t.scores_by_order, t.parts)
            assert moved(view) and not any("description" in c for c in moved(view))
            frame = scoring.attach_similarity(t.works, t.similarity)
            assert moved(frame) == []
            assert same(view, scoring.scored_view(t.works, t.scores))
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(IN_PLACE_KEY)
    with pytest.raises(ZeroDivisionError), joined_in_place(spark):
        assert spark.conf.get(IN_PLACE_KEY) == "false"
        1 / 0
    assert spark.conf.get(IN_PLACE_KEY) == before


def test_a_resembled_work_of_another_order_is_found(spark, t):
    first = t.works.orderBy("work_key").limit(40).collect()
    keys = [r["work_key"] for r in first]
    orders = {r["work_key"]: r["order_id"] for r in first}
    asked = {keys[0]: keys[39], keys[1]: "nobody", keys[2]: None, keys[3]: keys[39]}
    made = spark.createDataFrame(
        [(k, asked.get(k), orders[k]) for k in keys],
        "work_key string, similar_work_key string, order_id bigint")
    scores = t.scores.drop("similar_work_key").join(made, "work_key").select(
        *scoring.SCORE_COLUMNS, "order_id")
    dealt = [cut_by(df.repartition(4, "order_id"), "by_hand", "order_id", 4)
             for df in (t.works.filter(t.works.work_key.isin(keys)), scores)]
    with joined_in_place(spark):
        rows = scoring.scored_view(*dealt, 4).collect()
    assert len(rows) == 40
    assert {r["work_key"]: r["similar_work_key"] for r in rows if r["similar_work_key"]} == {
        keys[0]: keys[39], keys[3]: keys[39]}


def test_orphans_are_dropped_where_they_lie(t):
    kept = t.works.filter("order_id % 4 <> 0")
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(t.spark):
            found = publish.drop_orphans(t.scores_by_order, kept, ("order_id",))
            assert moved(found) == []
            assert same(found.drop("order_id"), publish.drop_orphans(t.scores, kept))
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_agencies_are_asked_for_where_the_works_lie(t, monkeypatch):
    rates = cut(peers.agency_delay_rate(scoring.timed(t.works, t.p)), "rates")
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(t.spark):
            frame = t.works.withColumn(
                "ls_term", F.when(F.col("order_id") % 3 != 0, F.col("ls_term"))).withColumn(
                "implementing_agency",
                F.when(F.col("order_id") % 5 != 0, F.col("implementing_agency")))
            plain = scoring.attach_agencies(frame, rates, t.profile)
            assert any("description" in c for c in moved(plain))
            for few in (0, 10 ** 6):
                found = scoring.attach_agencies(
                    frame, rates, t.profile, ("order_id",), t.parts, few)
                assert not any("description" in c for c in moved(found))
                assert same(found.select(*plain.columns), plain)
            monkeypatch.setattr(scoring.attach_agencies, "__defaults__", ((), None, 0))
            scores = scoring.score_works(t.works, t.payments, t.p, t.similarity, False,
                                         beside=("order_id",), parts=t.parts)
            assert same(scores.select(*scoring.SCORE_COLUMNS), t.scores)
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verdicts_are_made_and_joined_where_the_works_lie(t):
    plain = ledger.current_verdict(*ledger.split_events(
        ledger.accepted(t.review_events, t.works)[0]))
    assert same(t.verdicts.drop("order_id"), plain) and not plain.isEmpty()
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(t.spark):
            good, refused = ledger.accepted(t.review_events, t.works, ("order_id",))
            verdicts = ledger.current_verdict(good, beside=("order_id",))
            assert moved(verdicts) == []
            assert same(verdicts, t.verdicts)
            assert same(refused, ledger.accepted(t.review_events, t.works)[1])
        # The queues are planned with the session's own settings.
        reviewed = queue.with_reviews(t.scored, t.verdicts)
        assert moved(reviewed) == []
        apart = queue.with_reviews(t.scored, plain)
        assert any("description" in c for c in moved(apart))
        assert same(reviewed.select(*apart.columns), apart)
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
