"""Comparing rows within groups of any size, a bounded block at a time.

A group's rows are split into blocks by a hash of their id, and every task sees one block of
each side. No task holds a group, no pair of rows is ever emitted: a task returns at most one
row per row of its left block.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
PACK = 256
#: Rows that travel together where blocks are smaller: each is sent to fewer tasks.
TRAVEL = 2048


def _block(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.col(blocks)).cast("int")


def _blocks(left: DataFrame, right: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per group present on both sides: blocks of either side, and the pack it travels in."""
    n = F.count(F.lit(1))
    rows = left.groupBy(*keys).agg(n.alias("__cl")).join(
        right.groupBy(*keys).agg(n.alias("__cr")), keys)
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(size))).cast("int")
    packs = F.ceil(F.sum(F.greatest("__cl", "__cr")) / F.lit(float(PACK))).alias("__packs")
    return (
        rows.join(F.broadcast(rows.agg(packs)))
        .withColumn("__pack", F.pmod(F.xxhash64(*keys), F.col("__packs")))
        .withColumn("__nl", blocks("__cl")).withColumn("__nr", blocks("__cr"))
        .drop("__cl", "__cr", "__packs")
    )


def compare_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
    compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    size: int = BLOCK,
) -> DataFrame:
    """``compare`` on every (left block, right block) of each group; groups with an empty
    side yield nothing. Keys must not be NULL.

    Blocks smaller than ``TRAVEL`` rows travel together and are compared one by one. Small groups
    travel in packs of about ``PACK`` rows: a thousand groups of two rows cost a
    handful of calls, not a thousand.
    """
    blocks = _blocks(left, right, keys, max(size, TRAVEL))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = left.join(blocks, keys).withColumn("__l", _block(left_id, "__nl")).withColumn(
        "__r", spread("__nr")).drop("__nl", "__nr")
    rights = right.join(blocks, keys).withColumn("__r", _block(right_id, "__nr")).withColumn(
        "__l", spread("__nl")).drop("__nl", "__nr")
    # Both sides come from one frame: fresh column ids keep the cogroup unambiguous.
    rights = rights.select(*[F.col(c).alias(c) for c in rights.columns])
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        theirs = b.groupby(keys, sort=False).indices if len(b) else {}
        ours = a.groupby(keys, sort=False).indices if len(a) else {}
        cut_up = lambda at: [at[k:k + size] for k in range(0, len(at), size)]
        found = [compare(a.iloc[one], b.iloc[other])
                 for group, at in ours.items() if group in theirs
                 for one in cut_up(at) for other in cut_up(theirs[group])]
        found = [part for part in found if len(part)]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    by = ["__pack", "__l", "__r"]
    # Few bytes, much arithmetic: asked for by number, so AQE does not merge the tasks by size.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        lefts.repartition(tasks, *by).groupBy(*by)
        .cogroup(rights.repartition(tasks, *by).groupBy(*by)).applyInPandas(run, schema)
    )
