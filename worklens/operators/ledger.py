"""Reviewers' decisions: an append-only log, and the current verdict derived from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import current_version, publish, read_published

DECISIONS = ("verified", "dismissed", "escalated")
CLEAR = "pending"


def accepted(new: DataFrame, works: DataFrame,
             beside: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused rows carry why - a bad status or an unknown work.

    ``beside`` names columns of both tables that go with the work's key.
    """
    key = ["work_key", *beside]
    # Decisions are few and works many: the works are narrowed to the decided ones first.
    asked = new.select(*key).distinct()
    known = works.select(*key).join(asked, key, "left_semi").distinct().withColumn(
        "__known", F.lit(True))
    judged = new.join(known, key, "left")
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*DECISIONS, CLEAR), F.lit(False)),
               "Unknown status")
        .when(F.col("__known").isNull(), "No work with that work_key")
    )
    judged = judged.withColumn("refused", reason).drop("__known")
    return (judged.filter(F.col("refused").isNull()).drop("refused"),
            judged.filter(F.col("refused").isNotNull()))


def split_events(accepted_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, clears): clearing removes a verdict but is no event of the trail."""
    clears = F.col("status") == CLEAR
    return accepted_rows.filter(~clears), accepted_rows.filter(clears)


def append_decisions(new: DataFrame, works: DataFrame, log_path: str) -> DataFrame:
    """Append the accepted rows to the log in one atomic write; returns the refused ones."""
    good, refused = accepted(new, works)
    good.write.mode("append").parquet(log_path)
    return refused


def current_verdict(decisions: DataFrame, clears: DataFrame | None = None,
                    beside: tuple[str, ...] = ()) -> DataFrame:
    """Latest decision per work, unless the work was cleared after it.

    Without ``clears`` they are among the ``decisions``, and events that lie by columns ``beside``
    the work's key, which go with it, stay where they are.
    """
    events = decisions if clears is None else decisions.unionByName(clears)
    order = F.struct("created_at", "event_id")
    latest = events.groupBy("work_key", *beside).agg(
        F.max_by(F.struct("status", "note", "reviewer", "created_at"), order).alias("last"))
    return latest.select("work_key", *beside, "last.*").filter(F.col("status") != CLEAR).select(
        "work_key", "status", "note", "reviewer", F.col("created_at").alias("updated_at"), *beside)


def history(decisions: DataFrame, work_key: str, limit: int = 200) -> DataFrame:
    return (
        decisions.filter(F.col("work_key") == work_key)
        .orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)
        .select("status", "note", "reviewer", "created_at")
    )


# --------------------------------------------------- the log as batches, compacted


BATCHES, SNAPSHOT = "batches", "latest-events"
EVENT = "work_key string, status string, note string, reviewer string, created_at timestamp, " \
    "event_id bigint"


def append_batch(good: DataFrame, root: str, batch: int) -> None:
    """Write accepted events as a batch of the log under ``root``.

    Batches are numbered by the one job that writes the log, each more than all before; a
    number met twice fails, so that no batch can slip in behind a snapshot that covers it.
    """
    good.select(*[f.split()[0] for f in EVENT.split(", ")]).write.mode("errorifexists").parquet(
        f"{root}/{BATCHES}/batch={int(batch)}")


def _batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{EVENT}, batch bigint").parquet(f"{root}/{BATCHES}")


def _latest(events: DataFrame) -> DataFrame:
    """Last event of each work, clears included: folding folds again gives the same."""
    names = [f.split()[0] for f in EVENT.split(", ")]
    return events.groupBy("work_key").agg(F.max_by(
        F.struct(*names[1:]), F.struct("created_at", "event_id")).alias("last")).select(
        "work_key", "last.*")


def _covered(spark: SparkSession, root: str) -> int:
    """Number of the last batch that the published snapshot holds; -1 without a snapshot."""
    version = current_version(spark, root, SNAPSHOT)
    return -1 if version is None else int(version.split("-")[0])


def latest_events(spark: SparkSession, root: str) -> DataFrame:
    """Last event of each work: the snapshot folded with the batches after it.

    A late event, written after the snapshot but created before it, is weighed by its own time
    like any other. Batches that the snapshot holds are pruned by their folders.
    """
    covered = _covered(spark, root)
    tail = _batches(spark, root).filter(F.col("batch") > covered).drop("batch")
    if covered < 0:
        return _latest(tail)
    return _latest(read_published(spark, root, SNAPSHOT).unionByName(tail))


def compact(spark: SparkSession, root: str, through: int) -> int:
    """Publish a snapshot of all batches up to ``through`` and say how many it took in.

    It reads the last snapshot and the batches between; readers keep the last one until the new
    one is whole. A number already covered changes nothing.
    """
    covered = _covered(spark, root)
    if through <= covered:
        return 0
    between = _batches(spark, root).filter(F.col("batch").between(covered + 1, through))
    taken = between.select("batch").distinct().count()
    events = between.drop("batch")
    if covered >= 0:
        events = read_published(spark, root, SNAPSHOT).unionByName(events)
    publish(_latest(events), root, SNAPSHOT, f"{int(through)}-{uuid.uuid4().hex}")
    return taken


def verdicts_of(latest: DataFrame) -> DataFrame:
    """Current verdicts from the last events: a cleared work has none."""
    return latest.filter(F.col("status") != CLEAR).select(
        "work_key", "status", "note", "reviewer", F.col("created_at").alias("updated_at"))
