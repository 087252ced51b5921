"""Isolation-forest outliers (Liu, Ting and Zhou, 2008) with trees grown and applied on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.functions.expr import number
from rinseworks.operators.quantiles import exact_quantiles

TREES = 100
SAMPLE = 256


def _expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_trees(df: DataFrame, columns: list[str], rows: int, seed: int) -> pd.DataFrame:
    """All trees as node tables, each grown in its own task from at most 256 rows."""
    pool = df.sample(False, min(1.0, 1.3 * TREES * SAMPLE / rows), seed)
    share = min(1.0, 1.3 * SAMPLE / min(rows, 1.3 * TREES * SAMPLE))
    drawn = (
        pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
        .withColumn("draw", F.rand(seed))
        .where(F.col("draw") <= share)
    )

    def grow(points: pd.DataFrame) -> pd.DataFrame:
        tree = int(points["tree"].iloc[0])
        data = points.sort_values("draw")[columns].to_numpy(float)[:SAMPLE]
        rng = np.random.default_rng((seed, tree))
        deepest = math.ceil(math.log2(max(len(data), 2)))
        nodes: list[list[float]] = []

        def split(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + _expected_path(len(part))])
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < deepest and len(part) > 1 and len(open_):
                feature = rng.choice(open_)
                cut = rng.uniform(low[feature], high[feature])
                left = part[:, feature] <= cut
                nodes[at][2:4] = [feature, cut]
                nodes[at][4] = split(part[left], depth + 1)
                nodes[at][5] = split(part[~left], depth + 1) if not left.all() else nodes[at][4]
            return at

        split(data, 0)
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "cut", "left", "right", "length"]
        )

    return (
        drawn.groupBy("tree")
        .applyInPandas(
            grow,
            "tree int, node int, feature int, cut double, left int, right int, length double",
        )
        .toPandas()  # at most 100 trees of 511 nodes
        .sort_values(["tree", "node"])
    )


def isolation_scores(df: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """The rows complete in the columns with ``anomaly_score`` (higher is more isolated)."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & number(df, c).isNotNull()
    clean = df.where(complete)
    points = clean.select(*[number(df, c).alias(c) for c in columns])
    rows = points.count()
    if rows < 10:
        return clean.limit(0).withColumn("anomaly_score", F.lit(0.0))
    nodes = grow_trees(points, columns, rows, seed)
    forest = df.sparkSession.sparkContext.broadcast(
        [
            tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "length"))
            for _, t in nodes.groupby("tree")
        ]
    )
    scale = _expected_path(min(SAMPLE, rows))

    @F.pandas_udf("double")
    def isolation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            data = frame.to_numpy(float)
            total = np.zeros(len(data))
            for feature, cut, left, right, length in forest.value:
                at = np.zeros(len(data), int)
                while len(moving := np.flatnonzero(feature[at] >= 0)):
                    here = at[moving]
                    goes = data[moving, feature[here]] <= cut[here]
                    at[moving] = np.where(goes, left[here], right[here])
                total += length[at]
            yield pd.Series(2.0 ** (-total / len(forest.value) / scale))

    vector = F.struct(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    return clean.withColumn("anomaly_score", isolation(vector))


def isolation_forest_flags(
    df: DataFrame, columns: list[str], contamination: float = 0.1, seed: int = 42
) -> DataFrame:
    """The given share of rows that random splits isolate fastest; fewer than ten rows, none."""
    scored = durable(isolation_scores(df, columns, seed))  # the quantile search reads it often
    cut = exact_quantiles(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"]
    return scored.limit(0) if cut is None else scored.where(F.col("anomaly_score") > cut[0])
