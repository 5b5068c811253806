"""Search by posted runs against the exact test over all rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from worklens.operators import postings
from worklens.plans.queue import any_contains
from worklens.session import shared_dir

ROWS = "key int, name string, town string, note int"


def _index(spark, rows, block_rows, fields=("name", "town")):
    df = spark.createDataFrame(rows, ROWS)
    path = f"{shared_dir(spark)}/test-index-{uuid.uuid4().hex}"
    return df, postings.write_index(df, path, list(fields), ["town", "key"], block_rows)


def _keys(df):
    return sorted(r["key"] for r in df.select("key").collect())


@pytest.fixture(scope="module")
def posted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcİ éß%_") for _ in range(rng.randint(0, 7)))
    rows = [(i, word() if i % 9 else None, word() if i % 7 else None, i) for i in range(900)]
    rows += [(2000 + i, "well", "same town", 0) for i in range(300)]
    rows += [(3000, "A rare Zebra", "same town", 0), (3001, "zeb", "ra", 0)]
    return _index(spark, rows, 50)


@pytest.mark.parametrize("q", ["a", "B", "ab", "abc", "bca ", "%", "_a", "é", "ßa", "same town",
                               "zebra", "eb", "q", "not there", "b%c", " "])
def test_candidates_lose_no_match(posted, q):
    df, index = posted
    for fields in (["name"], ["town"], ["name", "town"]):
        exact = any_contains(fields, q)
        found = postings.candidates(index, fields, q)
        assert found.columns == df.columns
        assert _keys(found.filter(exact)) == _keys(df.filter(exact))


def test_blocks_and_postings_are_whole_and_bounded(posted):
    df, index = posted
    assert _keys(index.store) == _keys(df)
    assert _keys(postings.candidates(index, ["name"], "")) == _keys(df)
    assert index.postings.agg(F.max(F.size("places"))).first()[0] <= 200
    places = index.store.groupBy("block", "place").count()
    assert places.filter("count > 1").isEmpty()


def test_runs_of_one_row_only_count_together(posted):
    """A text whose runs stand in different rows or fields opens no block."""
    _, index = posted
    assert postings.hits(index, ["name", "town"], "zebra").agg(F.sum("hits")).first()[0] == 1
    assert _keys(postings.candidates(index, ["town"], "zebra")) == []


def test_files_read_fall_with_selectivity(spark, files_read):
    rows = [(i, f"work {i:05d}", f"town {i // 40:03d}", 0) for i in range(4000)]
    _, index = _index(spark, rows, 100)
    read = {q: files_read(postings.candidates(index, ["name", "town"], q), "/store")
            for q in ("work", "town 05", "01234")}
    assert read["work"] >= 35
    assert read["town 05"] <= 12
    assert 1 <= read["01234"] <= 3
    files = len(index.postings.inputFiles())
    assert files_read(postings.hits(index, ["name", "town"], "01234"), "/postings") < files


def test_empty_table_clashing_and_unposted_columns(spark):
    df, index = _index(spark, [], 10)
    assert _keys(postings.candidates(index, ["name"], "a")) == []
    assert _keys(postings.candidates(index, ["name"], "abc")) == []
    assert _keys(postings.candidates(index, ["name"], "")) == []
    with pytest.raises(ValueError, match="Block"):
        postings.write_index(df.withColumn("Block", F.lit(1)), "/tmp/never", ["name"], ["key"])
    with pytest.raises(ValueError, match="not posted"):
        postings.candidates(index, ["note"], "abc")


def test_rollup_counts_distinct_without_copying_rows(spark):
    from worklens.plans import desks

    cols = ("district string, implementing_agency string, mp_id string, work_status string, "
            "risk_level string, sanctioned_amount decimal(18,2), expenditure decimal(18,2), "
            "overall_risk_score double")
    rows = [(f"d{i % 3}" if i % 5 else None, f"a{i % 7}", f"m{i % 11}" if i % 4 else None,
             ("completed", "recommended", "open")[i % 3], ("LOW", "MEDIUM", "HIGH", None)[i % 4],
             i, None if i % 6 else i, None if i % 9 == 0 else i / 10) for i in range(200)]
    df = spark.createDataFrame([(*r[:5], *map(_money, r[5:7]), r[7]) for r in rows], cols)
    got = desks.risk_rollup(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    r = got.first().asDict()
    scores = [x[7] for x in rows if x[7] is not None]
    queue = [x for x in rows if x[4] in ("MEDIUM", "HIGH")]
    assert r == {
        "works": 200, "completed": 67, "pending": 67, "high_risk": 50, "in_queue": 100,
        "sanctioned": float(sum(x[5] for x in rows)),
        "expenditure": float(sum(x[6] or 0 for x in rows)),
        "flagged_amount": float(sum(x[5] for x in queue)),
        "districts": 3, "agencies": 7, "members": 11,
        "avg_risk": pytest.approx(round(sum(scores) / len(scores), 1))}
    none = desks.risk_rollup(df.limit(0)).first()
    assert none["works"] == none["districts"] == 0 and none["avg_risk"] is None


def _money(x):
    from decimal import Decimal

    return None if x is None else Decimal(x)


def test_postings_are_made_where_the_blocks_lie(spark, tmp_path):
    """Every run of every row is posted once, also of odd letters, and nothing is shuffled for it."""
    texts = ["Old Road", "old road", "", None, "aaaaaa", "a", "ab", "\U0001F600 xİß", "ΣΣ ẞ"]
    df = spark.createDataFrame([(k, texts[k % 9], texts[(k * 5) % 7]) for k in range(500)],
                               "key int, name string, town string")
    index = postings.write_index(df, str(tmp_path / "index"), ["name", "town"], ["key"], 90)
    assert "Exchange" not in postings._post(index.store, ["name"])._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.field, r.run, r.block, p) for r in index.postings.collect() for p in r.places)
    wanted = set()
    for field in ("name", "town"):
        for r in index.store.select("block", "place", F.lower(field).alias("low")).collect():
            low = (r.low or "") + postings.PAD * 2
            wanted |= {(field, low[i:i + 3], r.block, r.place) for i in range(len(low) - 2)}
    assert got == sorted(wanted)
