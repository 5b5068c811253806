"""Session settings and the shared folder that derived tables are cut to."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
IN_PLACE_KEY = "spark.sql.requireAllClusterKeysForCoPartition"
#: How cut tables are compressed: they are written once, and lie in the folder till the end.
PACKED = "zstd"


def get_session(app: str = "worklens", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    path = tempfile.mkdtemp(prefix="worklens-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_KEY, path)
    return path


def cut(df, label: str, even: bool = False):
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Written files outlive a lost executor, and being parquet they still let later
    reads prune columns and push filters down. ``even`` rebalances the rows first,
    for tables whose input arrives in a few large or lopsided files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if even else df).write.option("compression", PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df, label: str, key: str, buckets: int):
    """``cut`` with all rows of a ``key`` in one bucket: a join or grouping that has the key
    among its own, of tables in as many buckets, leaves the rows where they are.

    ``df`` is dealt by the key to as many parts already, or each task writes to all buckets.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    with joined_in_place(spark):
        df.write.format("parquet").bucketBy(buckets, key).option("compression", PACKED).option(
            "path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


@contextmanager
def joined_in_place(spark: SparkSession):
    """Jobs run herein join tables dealt by one of the join's keys as they lie.

    Otherwise the planner deals both sides anew by all keys, lest one key hold many rows; so this
    is for keys like an order, that hold few.
    """
    before = spark.conf.get(IN_PLACE_KEY)
    spark.conf.set(IN_PLACE_KEY, "false")
    try:
        yield
    finally:
        spark.conf.set(IN_PLACE_KEY, before)
