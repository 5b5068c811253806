"""Rows stored by key in buckets, and the merge of a day's rows into them.

A store is a bucketed table: all rows of a key lie in the bucket of its hash. A day's rows are
dealt to the same buckets and merged there, so the stored rows, many times more, are read and
written again in place and never cross the network. Each merge writes a whole new folder; the
one before stays as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


@dataclass(frozen=True)
class Store:
    """A bucketed table: its name in the session, its folder, its key and number of buckets."""

    table: str
    path: str
    key: str
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)


def _write(df: DataFrame, key: str, buckets: int) -> Store:
    name = f"store_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(
        name)
    return Store(name, path, key, buckets)


def create(df: DataFrame, key: str, buckets: int) -> Store:
    """Store rows of one row a key; rows without a key or with a repeated one are refused.

    A bucket is the unit of a task: choose ``buckets`` so that one holds some hundred megabytes.
    """
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) | F.col(key).isNull())
    if not bad.isEmpty():
        raise ValueError(f"rows without {key}, or several of one")
    return _write(df.repartition(buckets, key), key, buckets)


def attach(spark: SparkSession, store: Store, schema: str) -> Store:
    """Name a store written by an earlier session in this one."""
    if not spark.catalog.tableExists(store.table):
        spark.sql(f"CREATE TABLE {store.table} ({schema}) USING parquet CLUSTERED BY "
                  f"(`{store.key}`) SORTED BY (`{store.key}`) INTO {store.buckets} BUCKETS "
                  f"LOCATION '{store.path}'")
    return store


def merged(spark: SparkSession, store: Store, day: DataFrame, newest: str) -> DataFrame:
    """The stored rows with the day's in place of those of the same key, and its new ones.

    Of several rows of a key in the day, that with the largest ``newest`` counts, of equal ones
    the largest row; ``newest`` is a column of the day and may be one of the store. Rows without
    a key are left to the reject router and change nothing. The day has all columns of the
    store; others it may have are left out.
    """
    stored = store.rows(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in stored.columns])
    last = day.filter(F.col(store.key).isNotNull()).groupBy(
        F.col(store.key).cast(stored.schema[store.key].dataType).alias("__key")).agg(
        F.max_by(row, F.struct(F.col(newest).alias("o"), row.alias("r"))).alias("__new"))
    # Dealt to the store's own buckets: asked for less, the planner would move the stored side.
    last = last.repartition(store.buckets, "__key")
    both = stored.join(last, stored[store.key] == last["__key"], "full_outer")
    return both.select(*[
        F.when(F.col("__key").isNotNull(), F.col(f"__new.`{f.name}`").cast(f.dataType))
        .otherwise(stored[f"`{f.name}`"]).alias(f.name) for f in stored.schema.fields])


def merge(spark: SparkSession, store: Store, day: DataFrame, newest: str) -> Store:
    """Write the merged rows as a new store; the join leaves them in their buckets already."""
    return _write(merged(spark, store, day, newest), store.key, store.buckets)
