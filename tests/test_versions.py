"""Tables published slot by slot, and the review log with its snapshot."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from worklens.operators import ledger
from worklens.session import shared_dir
from worklens.sources import publish, store


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/test-versions-{uuid.uuid4().hex}"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_changed_row_rewrites_one_slot(spark, root):
    df = spark.range(2000).select(F.col("id").alias("key"), F.lit("a").alias("text"))

    def put(frame, **more):
        told = publish.publish_slots(frame, root, "t", ["key"], **{"slots": 32} | more)
        assert _rows(publish.read_slots(spark, root, "t")) == _rows(frame)
        return told["written"], told["kept"], told["dropped"]

    assert put(df) == (32, 0, 0)
    first = publish.current_version(spark, root, "t")
    assert put(df.orderBy(F.rand(1))) == (0, 32, 0)
    assert publish.current_version(spark, root, "t") == first
    changed = df.withColumn("text", F.when(F.col("key") == 77, None).otherwise(F.col("text")))
    assert put(changed) == (1, 31, 0)
    assert put(changed.filter("key <> 77")) == (1, 31, 0)
    assert put(changed.unionByName(changed.filter("key = 5"))) == (2, 30, 0)
    assert put(df.filter("key = 5")) == (1, 0, 31)
    assert put(df.limit(0)) == (0, 0, 1)
    assert put(df.limit(0)) == (0, 0, 0)
    assert put(df) == (32, 0, 0)
    assert put(df.withColumn("more", F.lit(1))) == (32, 0, 0)
    assert put(df.withColumn("more", F.lit(1)), slots=4) == (4, 0, 0)


def test_only_current_folders_are_read(spark, root, files_read):
    df = spark.range(500).select(F.col("id").alias("key"), F.lit(0).alias("v"))
    for v in range(3):
        publish.publish_slots(df.withColumn("v", F.lit(v)), root, "t", ["key"], 16)
    every = spark.read.parquet(f"{root}/t/data")
    assert len(every.inputFiles()) >= 48
    assert files_read(publish.read_slots(spark, root, "t"), "/t/data") <= len(every.inputFiles()) // 3


def test_null_and_repeated_keys_and_prints_that_merge(spark, root):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, ""), (1, None)], "key int, text string")
    publish.publish_slots(df, root, "t", ["key"], 4)
    assert _rows(publish.read_slots(spark, root, "t")) == _rows(df)
    whole = publish.fingerprint(t=df).first()
    parts = publish.slot_prints(df, ["key"], 4).agg(
        F.sum("rows"), F.sum(F.col("sum_a").cast("decimal(38,0)")).cast("string"),
        F.bit_xor("xor_b")).first()
    assert tuple(parts) == (whole["rows"], whole["sum_a"], whole["xor_b"])


def test_snapshot_and_tail_equal_the_full_fold(spark, root, files_read):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    events = [(f"w{rng.randrange(40)}", rng.choice((*ledger.DECISIONS, ledger.CLEAR)),
               rng.choice(("n", None)), "r", day + dt.timedelta(hours=rng.randrange(200)), i)
              for i in range(300)]
    for batch in range(6):
        part = spark.createDataFrame(events[batch * 50:batch * 50 + 50], ledger.EVENT)
        ledger.append_batch(part, root, batch)
        if batch == 1:
            assert ledger.compact(spark, root, 1) == 2
        if batch == 4:
            assert ledger.compact(spark, root, 3) == 2
            assert ledger.compact(spark, root, 2) == 0
        so_far = spark.createDataFrame(events[:batch * 50 + 50], ledger.EVENT)
        assert _rows(ledger.verdicts_of(ledger.latest_events(spark, root))) == _rows(
            ledger.current_verdict(*ledger.split_events(so_far)))
    # Batches 4 and 5 are the tail: no folder before them is opened.
    one = len(spark.read.parquet(f"{root}/{ledger.BATCHES}").inputFiles()) // 6
    assert files_read(ledger.latest_events(spark, root), ledger.BATCHES) <= 2 * one
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ledger.append_batch(spark.createDataFrame(events[:1], ledger.EVENT), root, 5)


ROW = "key string, amount double, day int"


def _stored_side_moves(df):
    """Whether a shuffle stands between the join and the scan of the bucketed table."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text, text
    return "Exchange hashpartitioning(key#" in text


def test_merge_by_key_moves_the_day_alone(spark):
    stored = [(f"k{i}", float(i), 0) for i in range(400)]
    kept = store.create(spark.createDataFrame(stored, ROW), "key", 6)
    assert spark.table(kept.table).count() == 400
    day = [("k7", 70.0, 2), ("k7", 71.0, 1), ("k8", None, 1), ("new", 1.0, 1), ("new", 2.0, 1),
           (None, 9.0, 1)]
    frame = spark.createDataFrame(day, ROW).withColumn("__key", F.lit("clash"))
    both = store.merged(spark, kept, frame, "day")
    assert not _stored_side_moves(both)
    after = store.merge(spark, kept, frame, "day")
    want = {k: (k, a, d) for k, a, d in stored} | {
        "k7": ("k7", 70.0, 2), "k8": ("k8", None, 1), "new": ("new", 2.0, 1)}
    assert _rows(after.rows(spark)) == sorted(want.values(), key=repr)
    assert _rows(kept.rows(spark)) == sorted(stored, key=repr)
    # A merged store is bucketed like the first: it merges again without moving.
    again = store.merged(spark, after, frame.limit(0), "day")
    assert _rows(again) == _rows(after.rows(spark))
    assert not _stored_side_moves(store.merged(spark, after, frame, "day"))
    files = len(after.rows(spark).inputFiles())
    assert files <= 6


def test_store_is_attached_again_and_refuses_bad_keys(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], ROW)
    kept = store.create(df, "key", 3)
    spark.sql(f"DROP TABLE {kept.table}")
    store.attach(spark, kept, ROW)
    assert _rows(kept.rows(spark)) == _rows(df)
    assert not _stored_side_moves(store.merged(spark, kept, df, "day"))
    empty = store.create(df.limit(0), "key", 3)
    assert _rows(store.merge(spark, empty, df, "day").rows(spark)) == _rows(df)
    for bad in ([("a", 1.0, 1), ("a", 1.0, 1)], [(None, 1.0, 1)]):
        with pytest.raises(ValueError, match="key"):
            store.create(spark.createDataFrame(bad, ROW), "key", 3)
