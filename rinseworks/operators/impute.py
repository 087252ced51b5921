"""Imputation by mean, median, mode, group mode, neighbours and regression."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable, localize, per_column, small_frame
from rinseworks.functions.expr import is_missing, number, numeric_columns, ref, strip, text_columns
from rinseworks.operators.cells import Boxes, CellTree
from rinseworks.operators.frequency import column_mode, value_counts
from rinseworks.operators.quantiles import exact_quantiles

# Rows per side of one distance block of neighbour imputation; donors that the tree of cells
# is fitted on, and how many of them make a cell.
DONOR_BLOCK = 4096
RECEIVER_BLOCK = 1024
SAMPLE = 16_384
LEAF = 24


def fill(df: DataFrame, column: str, value: object) -> DataFrame:
    if value is None:
        return df
    return df.withColumn(
        column, F.when(is_missing(df, column), F.lit(value)).otherwise(ref(column))
    )


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Numbers only; other columns stay as they are."""
    if not _is_number(df, column):
        return df
    return fill(df, column, df.agg(F.avg(number(df, column))).first()[0])


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Exact median, the midpoint of two; numbers only."""
    if not _is_number(df, column):
        return df
    q = exact_quantiles(df, [column], [0.5])[column]
    return df if q is None else fill(df, column, q[0])


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest among equals; any type."""
    present = F.when(~is_missing(df, column), ref(column))
    return fill(df, column, column_mode(df, present))


def text_parents(
    df: DataFrame, target: str, limit: int, min_distinct: int, enough: Callable[[float], bool]
) -> list[tuple[str, int]]:
    """Other text columns with few distinct values and enough filled cells, in order.

    Distinct values are only needed up to the limit, so a sketch rules out the clearly
    wide columns and the exact count runs on the rest.
    """
    others = [c for c in text_columns(df) if c != target]
    seen = per_column(
        df,
        others,
        lambda c: [
            F.count(F.lit(1)).alias("total"),
            F.count(ref(c)).alias("present"),
            F.approx_count_distinct(ref(c)).alias("sketch"),
        ],
    ).collect()
    likely = [
        r["column"]
        for r in seen
        if r["total"] and enough(r["present"] / r["total"]) and r["sketch"] <= 2 * limit + 10
    ]
    if not likely:
        return []
    exact = {
        r["column"]: r["n"]
        for r in value_counts(df, likely)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    return [(c, exact.get(c, 0)) for c in likely if min_distinct <= exact.get(c, 0) <= limit]


def _group_mode(df: DataFrame, parents: list[str], value: Column) -> DataFrame:
    """``(parents..., __mode)``; at most the product of the parents' distinct values."""
    return (
        df.select(*[ref(p).alias(f"__p{i}") for i, p in enumerate(parents)], value.alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*[f"__p{i}" for i in range(len(parents))], "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
        .groupBy(*[f"__p{i}" for i in range(len(parents))])
        .agg(F.min_by("__v", F.struct((-F.col("__n")).alias("n"), F.col("__v"))).alias("__mode"))
    )


def impute_context_mode(
    df: DataFrame, column: str, max_parents: int = 2, max_categories: int = 30
) -> DataFrame:
    """Fill null or blank text by the mode of the rows with equal parents.

    Parents are up to two other text columns with 2 to 30 distinct values and at most
    half missing, fewest distinct first. Rows without a group mode get the overall one.
    Deviation: blanks are no candidates for either mode.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    found = text_parents(df, column, max_categories, 2, lambda share: share >= 0.5)
    parents = [c for c, _ in sorted(found, key=lambda item: item[1])[:max_parents]]
    value = F.when(strip(ref(column)) != "", ref(column))
    overall = column_mode(df, value)
    if overall is None:
        return df
    if not parents:
        return df.withColumn(column, F.coalesce(value, F.lit(overall)))
    modes = durable(_group_mode(df, parents, value))
    same = [ref(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(parents)]
    # (max_categories + 1) ** max_parents rows at most; Spark broadcasts them if small
    return (
        df.join(modes, same, "left")
        .withColumn(column, F.coalesce(value, F.col("__mode"), F.lit(overall)))
        .select(*[ref(c) for c in df.columns])
    )


def impute_parent_mode(df: DataFrame, column: str) -> tuple[DataFrame, str | None]:
    """Fill nulls by the mode under the first suitable text column, else the overall mode.

    The parent is the first other text column with at most 30 distinct values and more
    than half its cells filled. The overall mode is taken after the group fill.
    """
    found = [c for c, _ in text_parents(df, column, 30, 0, lambda share: share > 0.5)]
    present = F.when(~is_missing(df, column), ref(column))
    parent = found[0] if found else None
    if parent is not None:
        modes = localize(_group_mode(df, [parent], present))  # at most 31 rows
        known = F.broadcast(modes.where(F.col("__p0").isNotNull()))
        df = (
            df.join(known, ref(parent) == F.col("__p0"), "left")
            .withColumn(column, F.coalesce(present, F.col("__mode")))
            .select(*[ref(c) for c in df.columns])
        )
    overall = column_mode(df, F.when(~is_missing(df, column), ref(column)))
    return fill(df, column, overall), parent


# --- nearest neighbours ------------------------------------------------------


def impute_knn(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Fill every numeric column by the mean of the k nearest rows that have the value.

    The distance is Euclidean over the numeric columns both rows have, scaled up by the
    share of columns compared; ties go to the smaller key. A row that shares no column
    with any donor gets the column mean. ``key`` identifies rows.
    """
    columns = numeric_columns(df)
    known = _moments(df, columns)
    columns = [c for c in columns if known[c]["present"] > 0]
    gaps = [c for c in columns if known[c]["present"] < known[c]["total"]]
    if not gaps:
        return df
    points = durable(df.select(ref(key).alias("id"), F.array(*[number(df, c) for c in columns]).alias("x")))
    out = df
    for c in gaps:
        best = nearest_donors(points, columns.index(c), len(columns), k)
        fills = best.groupBy("receiver").agg(F.avg("value").alias("__fill"))
        out = (
            out.join(fills, ref(key) == F.col("receiver"), "left")
            .withColumn(
                c,
                F.when(
                    is_missing(df, c), F.coalesce("__fill", F.lit(known[c]["mean"]))
                ).otherwise(ref(c).cast("double")),
            )
            .select(*[ref(name) for name in df.columns])
        )
    return out


def _moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    rows = per_column(
        df,
        columns,
        lambda c: [
            F.count(F.lit(1)).alias("total"),
            F.count(number(df, c)).alias("present"),
            F.avg(number(df, c)).alias("mean"),
            F.max(F.abs(number(df, c))).alias("largest"),
        ],
    ).collect()
    return {r["column"]: r.asDict() for r in rows}


def _matrix(column, width: int) -> np.ndarray:
    """Arrays of one width as rows, gaps as NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


@dataclass
class DonorIndex:
    """Donors of one column in cells, ``(id, x, cell)``, and the boxes of the cells."""

    donors: DataFrame
    boxes: Boxes
    target: int
    width: int
    donor_block: int

    @classmethod
    def build(cls, points: DataFrame, target: int, width: int, sample: int, leaf: int, donor_block: int) -> DonorIndex:
        """The tree is fitted on a bounded sample of donors; boxes are measured over all."""
        giving = points.where(F.col("x")[target].isNotNull())
        chosen = giving.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").toArrow()
        tree = CellTree.fit(_matrix(chosen.column("x").combine_chunks(), width), leaf)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("cell", pa.array(tree.assign(_matrix(batch.column("x"), width))))

        kind = points.schema["id"].dataType.simpleString()
        donors = durable(giving.mapInArrow(put, f"id {kind}, x array<double>, cell long"))
        x = [F.col("x")[j] for j in range(width)]
        rows = donors.groupBy("cell").agg(
            F.count("*").alias("n"), F.array(*map(F.min, x)).alias("low"), F.array(*map(F.max, x)).alias("high"),
            F.array(*map(F.count, x)).alias("present"),
        ).orderBy("cell").collect()  # a row for each cell of the tree
        n = np.array([r.n for r in rows], np.int64)
        low, high = (np.array([[v or 0.0 for v in r[c]] for r in rows]).reshape(-1, width) for c in ("low", "high"))
        present = np.array([r.present for r in rows]).reshape(-1, width)
        boxes = Boxes(np.array([r.cell for r in rows], np.int64), n, low, high, present == n[:, None], present > 0)
        return cls(donors, boxes, target, width, donor_block)

    def visits(self, receivers: DataFrame, k: int, first: bool) -> DataFrame:
        """``(id, x, cell)``: the nearest cells that hold k rows, or with ``reach``, the k-th
        distance in these, all others that may hold a row as near."""
        boxes, width = self.boxes, self.width

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = boxes.nearest_possible(_matrix(batch.column("x"), width))
                order = np.argsort(bound, axis=1, kind="stable")
                near = np.take_along_axis(bound, order, axis=1)
                held = np.cumsum(np.where(np.isfinite(near), boxes.size[order], 0), axis=1)
                early = np.isfinite(near) & (held - boxes.size[order] < k)
                if not first:
                    reach = batch.column("reach").to_numpy(zero_copy_only=False)[:, None]
                    early = np.isfinite(near) & ~early & (near <= reach * (1 + 1e-9))
                row, place = np.nonzero(early)
                taken = batch.select(["id", "x"]).take(pa.array(row))
                yield taken.append_column("cell", pa.array(boxes.number[order[row, place]]))

        kind = receivers.schema["id"].dataType.simpleString()
        return receivers.mapInArrow(choose, f"id {kind}, x array<double>, cell long")

    def compare(self, visits: DataFrame, k: int, receiver_block: int) -> DataFrame:
        """``(receiver, donor, distance, value)``: the k nearest of each cell's donors.

        A task meets one block of a cell's donors with one block of its visitors.
        """
        load = visits.groupBy("cell").agg(F.ceil(F.count("*") / receiver_block).alias("down"))
        sizes = small_frame(
            visits.sparkSession,
            [(int(c), int(-(-n // self.donor_block))) for c, n in zip(self.boxes.number, self.boxes.size)],
            "cell bigint, across bigint",
        )
        load = load.join(F.broadcast(sizes), "cell")
        own = lambda n: F.pmod(F.xxhash64("id"), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        giving = self.donors.join(load, "cell").select("cell", "id", "x", own(F.col("across")).alias("b"), every(F.col("down")).alias("a"))
        taking = visits.join(load, "cell").select("cell", "id", "x", own(F.col("down")).alias("a"), every(F.col("across")).alias("b"))
        width, target = self.width, self.target

        def nearest(give: pa.Table, take: pa.Table) -> pa.Table:
            ids = give.column("id").combine_chunks()
            donors, asking = (_matrix(t.column("x").combine_chunks(), width) for t in (give, take))
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            rows, picks, far = [], [], []
            for i, x in enumerate(asking):
                gap = donors - x
                shared = np.count_nonzero(~np.isnan(gap), axis=1)
                at = np.flatnonzero(shared)
                total = np.nansum(gap[at] ** 2, axis=1)
                distance = np.sqrt(total * (width / shared[at]))
                if len(at) > k:
                    close = distance <= np.partition(distance, k - 1)[k - 1]
                    at, distance = at[close], distance[close]
                order = np.lexsort((rank[at], distance))[:k]
                rows.append(np.full(len(order), i))
                picks.append(at[order])
                far.append(distance[order])
            row, pick = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (rows, picks))
            return pa.table({
                "receiver": take.column("id").combine_chunks().take(pa.array(row)), "donor": ids.take(pa.array(pick)),
                "distance": np.concatenate([np.zeros(0), *far]), "value": donors[pick, target],
            })

        kind = visits.schema["id"].dataType.simpleString()
        return giving.groupBy("cell", "a", "b").cogroup(taking.groupBy("cell", "a", "b")).applyInArrow(
            nearest, f"receiver {kind}, donor {kind}, distance double, value double"
        )


def nearest_donors(
    points: DataFrame, target: int, width: int, k: int, sample: int | None = None, leaf: int | None = None
) -> DataFrame:
    """``(receiver, donor, distance, value)`` of the k nearest donors per receiver.

    ``points`` has ``id`` and ``x``, an array of ``width`` numbers or nulls; rows without
    ``x[target]`` receive, the others give. A receiver first meets the cells whose boxes are nearest
    until they hold k donors; the k-th distance found there tells which other cells can
    hold a nearer one, and only these are searched as well. The result is exact.
    """
    index = DonorIndex.build(points, target, width, sample or SAMPLE, leaf or LEAF, DONOR_BLOCK)
    receivers = points.where(F.col("x")[target].isNull())
    found = durable(index.compare(index.visits(receivers, k, True), k, RECEIVER_BLOCK))
    place = F.row_number().over(Window.partitionBy("receiver").orderBy("distance", "donor"))
    best = durable(found.withColumn("place", place).where(F.col("place") <= k))
    reach = best.groupBy(F.col("receiver").alias("__r")).agg(
        F.when(F.count("*") == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    again = receivers.join(reach, F.col("id") == F.col("__r"), "left").select(
        "id", "x", F.coalesce("reach", F.lit(float("inf"))).alias("reach")
    )
    more = index.compare(durable(index.visits(again, k, False)), k, RECEIVER_BLOCK)
    both = best.drop("place").unionByName(more)
    return both.withColumn("place", place).where(F.col("place") <= k).drop("place")


# --- round-robin regression --------------------------------------------------


def impute_iterative(df: DataFrame, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Fill numeric columns by regressing each on the others, round after round.

    Starts from the means, takes columns by ascending number of missing values and fits
    Bayesian ridge regressions. A fit needs only the sums of products, so rows without
    gaps are aggregated once and every step aggregates the rows with gaps alone; the
    solver sees a matrix of columns by columns. The imputed values are an expression
    over the fitted coefficients and are never stored between steps.
    """
    columns = numeric_columns(df)
    known = _moments(df, columns)
    columns = [c for c in columns if known[c]["present"] > 0]
    gaps = {c: known[c]["total"] - known[c]["present"] for c in columns}
    targets = sorted((c for c in columns if gaps[c] > 0), key=lambda c: gaps[c])
    if not targets or len(columns) < 2:
        return df
    centre = [known[c]["mean"] for c in columns]
    values = [number(df, c) for c in columns]
    full = F.lit(True)
    for v in values:
        full = full & v.isNotNull()
    shifted = F.array(*[v - F.lit(m) for v, m in zip(values, centre)]).alias("z")
    base = _gram(df.where(full).select(shifted), len(columns), None)
    partial = durable(df.where(~full).select(shifted))
    limit = tol * max(known[c]["largest"] for c in columns)
    steps: list[tuple[int, float, list[float]]] = []
    for _ in range(max_iter):
        before = list(steps)
        for c in targets:
            t = columns.index(c)
            now = partial.select(_folded(F.col("z"), steps).alias("y"), "z")
            sums = base + _gram(now, len(columns), t)
            steps.append((t, *_bayesian_ridge(sums, t)))
        change = F.zip_with(
            _folded(F.col("z"), steps), _folded(F.col("z"), before), lambda a, b: F.abs(a - b)
        )
        if partial.agg(F.max(F.array_max(change))).first()[0] < limit:
            break
    filled = df.withColumn("__y", _folded(shifted, steps))
    return filled.withColumns(
        {
            c: F.when(is_missing(df, c), F.col("__y")[i] + F.lit(centre[i])).otherwise(
                ref(c).cast("double")
            )
            for i, c in enumerate(columns)
            if gaps[c] > 0
        }
    ).drop("__y")


def _folded(z: Column, steps: list[tuple[int, float, list[float]]]) -> Column:
    """The centred row after all regression steps; gaps start at zero, the mean."""
    start = F.transform(z, lambda v: F.coalesce(v, F.lit(0.0)))
    if not steps:
        return start
    plan = F.array(
        *[
            F.struct(
                F.lit(t).alias("t"),
                F.lit(float(b)).alias("b"),
                F.array(*[F.lit(float(w)) for w in ws]).alias("w"),
            )
            for t, b, ws in steps
        ]
    )

    def apply(row, step):
        estimate = F.aggregate(
            F.zip_with(row, step["w"], lambda x, w: x * w), step["b"], lambda a, v: a + v
        )
        return F.transform(
            row,
            lambda v, i: F.when((i == step["t"]) & F.get(z, i).isNull(), estimate).otherwise(v),
        )

    return F.aggregate(plan, start, apply)


def _gram(df: DataFrame, width: int, target: int | None) -> np.ndarray:
    """Sums of products of ``[1, row]``, over the rows that have the target."""
    if target is not None:
        df = df.where(F.col("z")[target].isNotNull())
    row = F.col("z") if target is None else F.col("y")
    cells = [F.lit(1.0), *[row[i] for i in range(width)]]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    sums = df.agg(*[F.coalesce(F.sum(cells[i] * cells[j]), F.lit(0.0)) for i, j in pairs]).first()
    out = np.zeros((width + 1, width + 1))
    for (i, j), v in zip(pairs, sums):
        out[i, j] = out[j, i] = v
    return out


def _bayesian_ridge(sums: np.ndarray, target: int) -> tuple[float, list[float]]:
    """Evidence-maximising ridge regression from sums of products.

    Returns the intercept and one weight per column, zero for the target itself.
    """
    n = sums[0, 0]
    width = len(sums) - 1
    others = [i for i in range(width) if i != target]
    mean = sums[0, 1:] / n
    spread = sums[1:, 1:] - n * np.outer(mean, mean)
    xx = spread[np.ix_(others, others)]
    xy = spread[others, target]
    yy = max(spread[target, target], 0.0)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ xy
    tiny = 1e-6
    noise = 1.0 / (yy / n + np.finfo(float).eps)
    prior = 1.0
    weights = np.zeros(len(others))
    for _ in range(300):
        previous = weights
        weights = vectors @ (turned / (values + prior / noise))
        error = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        fitted = np.sum(noise * values / (prior + noise * values))
        prior = (fitted + 2 * tiny) / (weights @ weights + 2 * tiny)
        noise = (n - fitted + 2 * tiny) / (error + 2 * tiny)
        if np.sum(np.abs(previous - weights)) < 1e-3:
            break
    weights = vectors @ (turned / (values + prior / noise))
    full = np.zeros(width)
    full[others] = weights
    return float(mean[target] - mean @ full), full.tolist()
