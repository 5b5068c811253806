"""Isolation forest: trees grown on small hashed samples, kept as a relation of nodes.

Follows the published algorithm (Liu, Ting, Zhou 2008): 100 trees, 256 rows each, depth
limited to log2 of the sample. Samples, split features and thresholds are drawn by MD5 of
the key or of the node, so the forest does not depend on how the input happens to be
partitioned, and any engine can grow it again from the same rows and walk it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329
HASH_RANGE = 1 << 40


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    sample: int
    # A row a tree, a column a node: split feature (-1 in a leaf), threshold, path of a leaf.
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray


def _draw(df: DataFrame, features: list[str], key: str, trees: int, sample: int,
          seed: int) -> DataFrame:
    """(tree, hash, features) for the ``sample`` lowest hashes of every tree.

    Every row is offered to every tree: one MD5 of its key gives a start and a step, and each
    tree is a step further. A hash threshold thins a tree to a few hundred candidates inside
    the scan, twice as many as it draws; only those are shuffled and ranked, so the draw is the
    same whatever the number of rows.
    """
    rows = df.count()
    candidates = 2 * sample + 64
    bits = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))

    def number(at: int) -> Column:
        return F.conv(F.substring(bits, at, 10), 16, 10).cast("long")

    def draw(tree: Column) -> Column:
        return (F.col("start") + tree * F.col("step")) % F.lit(HASH_RANGE)

    values = df.select(
        F.col(key), number(1).alias("start"), number(11).alias("step"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    limit = int(min(1.0, candidates / max(rows, 1)) * HASH_RANGE)
    # Exploded and then filtered: compiled code, where a filter over the array is interpreted.
    offered = values.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = offered.withColumn("h", draw(F.col("tree"))).filter(F.col("h") < limit)
    lowest = Window.partitionBy("tree").orderBy("h", key)
    return drawn.drop("start", "step").withColumn(
        "place", F.row_number().over(lowest)).filter(F.col("place") <= sample)


def _grow(data: np.ndarray, depth_limit: int, name: str) -> list[tuple]:
    """(node, feature, threshold, path) of a tree; the root is 1, the children of n 2n and 2n + 1.

    The MD5 of ``name`` and the node says which of the features that differ is split, and where
    between its least and its greatest value. A leaf has feature -1 and the path that ends there.
    """
    nodes = []
    open_ = [(1, 0, data)]
    while open_:
        node, level, rows = open_.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if level < depth_limit and len(usable):
            bits = hashlib.md5(f"{name}:{node}".encode()).hexdigest()
            f = int(usable[int(bits[:10], 16) % len(usable)])
            cut = float(low[f] + int(bits[10:20], 16) / HASH_RANGE * (high[f] - low[f]))
            if cut < high[f]:
                goes_left = rows[:, f] <= cut
                nodes.append((node, f, cut, 0.0))
                open_ += [(2 * node, level + 1, rows[goes_left]),
                          (2 * node + 1, level + 1, rows[~goes_left])]
                continue
        nodes.append((node, -1, 0.0, level + mean_path(len(rows))))
    return nodes


def _levels(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def iforest_nodes(df: DataFrame, features: list[str], key: str, trees: int = 100,
                  sample: int = 256, seed: int = 42) -> DataFrame:
    """The grown forest as a relation: tree, rows drawn for it, node, feature, threshold, path.

    A row walks from node 1 of every tree to 2n where its feature is at most the threshold, else
    to 2n + 1, until the feature is -1. There are fewer than 4 x ``sample`` nodes in a tree.
    """
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        grown = _grow(pdf[names].to_numpy(dtype=float), _levels(sample), f"{seed}:{tree}")
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "path"])
        return out.assign(tree=tree, rows=len(pdf))[
            ["tree", "rows", "node", "feature", "threshold", "path"]]

    return _draw(df, names, key, trees, sample, seed).groupBy("tree").applyInPandas(
        grow, "tree int, rows int, node int, feature int, threshold double, path double")


def iforest_fit(df: DataFrame, features: list[str], key: str, trees: int = 100,
                sample: int = 256, seed: int = 42) -> Forest:
    """Fit on Spark; only the nodes (at most ``trees`` x 511 by default) reach the driver."""
    return forest_of(iforest_nodes(df, features, key, trees, sample, seed), features, trees, sample)


def forest_of(nodes: DataFrame, features: list[str], trees: int = 100, sample: int = 256) -> Forest:
    """A stored relation of nodes, ready to score with."""
    held = nodes.toPandas()
    count = trees if len(held) else 0
    feature = np.full((count, 2 << _levels(sample)), -1)
    threshold, path = np.zeros(feature.shape), np.zeros(feature.shape)
    at = held["tree"].to_numpy(), held["node"].to_numpy()
    if count:
        feature[at], threshold[at], path[at] = held["feature"], held["threshold"], held["path"]
    return Forest(tuple(features), int(held["rows"].max()) if count else 0, feature, threshold, path)


def iforest_score(model: Forest) -> Column:
    """Raw anomaly score of a row, in (0, 1): the shorter its mean path, the higher."""
    scale = mean_path(model.sample) or 1.0

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        data = frame.fillna(0.0).to_numpy(dtype=float)
        rows = np.arange(len(data))
        paths = np.zeros(len(data))
        for feature, threshold, path in zip(model.feature, model.threshold, model.path):
            at = np.ones(len(data), dtype=int)
            while True:
                split = feature[at]
                inner = split >= 0
                if not inner.any():
                    break
                above = data[rows, np.where(inner, split, 0)] > threshold[at]
                at = np.where(inner, 2 * at + above, at)
            paths += path[at]
        return pd.Series(np.power(2.0, -(paths / max(len(model.path), 1)) / scale))

    return score(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scale a score to 0-100 over the whole frame: a one-row aggregate, not a global window."""
    bounds = df.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    span = F.col("__high") - F.col("__low") + 1e-9
    return (
        df.join(F.broadcast(bounds))
        .withColumn(out, (F.col(score) - F.col("__low")) / span * 100)
        .drop("__low", "__high")
    )
