"""Small blocks travel together: fewer copies of a row, the same blocks compared."""

import pandas as pd
from pyspark.sql import functions as F

from worklens.operators import blocks


def test_small_blocks_travel_together(spark):
    left = spark.range(300).select(F.lit("g").alias("k"), F.col("id").alias("l"))
    right = spark.range(200).select(F.lit("g").alias("k"), F.col("id").alias("r"))

    def met(a, b):
        return pd.DataFrame([(len(a), len(b))], columns=["a", "b"])

    got = blocks.compare_blocks(left, right, ["k"], "l", "r", met, "a bigint, b bigint", size=10)
    rows = got.collect()
    assert sum(r.a * r.b for r in rows) == 300 * 200 and max(max(r.a, r.b) for r in rows) <= 10
    sizes = blocks._blocks(left, right, ["k"], max(10, blocks.TRAVEL)).first()
    assert sizes["__nl"] == sizes["__nr"] == 1
