"""Works that the nightly job deals by key once, and extracts that read the written lines."""

from pathlib import Path

from worklens.catalog import nightly_queries
from worklens.catalog.tables import Tables
from worklens.operators import ingest, labels
from worklens.plans import nightly
from worklens.session import cut_by
from worklens.sources import raw_fixtures

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_united_works_are_loaded_where_they_lie(spark):
    t = Tables(spark, SF)
    rec, com = (f(spark, SF, t.lines) for f in (raw_fixtures.recommended, raw_fixtures.completed))
    parts = nightly.parts_for({"recommended": rec, "completed": com})
    united = cut_by(ingest.unite_works(rec, com, parts=parts), "united", "work_key", parts)
    assert sorted(map(str, united.collect())) == sorted(map(str, ingest.unite_works(rec, com).collect()))
    accepted, _ = ingest.route_rejects(united, t.p)
    works = ingest.one_per_key(ingest.derive_works(accepted, t.p, ascii_only=True), "work_key")
    assert "Exchange hashpartitioning" not in _plan(works)
    cache = spark.createDataFrame([("old road", "Roads")], "text string, label string")
    assert "Exchange hashpartitioning" not in _plan(labels.fill_labels(works, cache, ascii_only=True))


def test_raw_rows_are_those_of_the_lines_and_join_nothing(spark):
    t = Tables(spark, SF)
    for make in (raw_fixtures.recommended, raw_fixtures.completed, raw_fixtures.payments):
        dealt, joined = make(spark, SF, t.lines), make(spark, SF)
        assert dealt.exceptAll(joined).isEmpty() and joined.exceptAll(dealt).isEmpty()
        assert "Join" not in _plan(dealt)


def test_extracts_are_packed(spark):
    folder, _ = nightly_queries._extracts(Tables(spark, SF))
    names = [p.name for p in Path(folder.removeprefix("file:")).rglob("part-*")]
    assert names and all(n.endswith(".csv.gz") for n in names)
