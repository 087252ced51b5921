"""Profiling: table statistics, column profiles, samples and outlier counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinseworks.frames import localize, per_column, small_frame, together
from rinseworks.functions.expr import is_missing, number, numeric_columns, percent, ref, text_columns
from rinseworks.operators.duplicates import count_duplicate_rows
from rinseworks.operators.frequency import distinct_counts
from rinseworks.operators.quantiles import exact_quantiles


@dataclass
class NumericSummary:
    """Moments, quartiles and outlier counts of one numeric column."""

    column: str
    rows: int
    present: int
    minimum: float | None
    maximum: float | None
    mean: float | None
    std_pop: float | None
    std_samp: float | None
    q1: float | None = None
    q3: float | None = None
    iqr_outliers: int = 0
    both_outliers: int = 0

    @property
    def fences(self) -> tuple[float, float] | None:
        if self.q1 is None:
            return None
        reach = 1.5 * (self.q3 - self.q1)
        return self.q1 - reach, self.q3 + reach


def summarize_numeric(
    df: DataFrame, columns: list[str] | None = None, outliers: bool = True
) -> list[NumericSummary]:
    """Summaries of all numeric columns from a few fused scans.

    Only a few numbers per column reach the driver.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return []

    def moments(c):
        v = number(df, c)
        return [
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("present"),
            F.min(v).alias("minimum"),
            F.max(v).alias("maximum"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std_pop"),
            F.stddev_samp(v).alias("std_samp"),
        ]

    found = per_column(df, columns, moments).drop("position").collect()
    out = [NumericSummary(**r.asDict()) for r in found]
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], {s.column: s.present for s in out})
    for s in out:
        if quartiles[s.column] is not None:
            s.q1, s.q3 = quartiles[s.column]
    if outliers:
        _count_outliers(df, out)
    return out


def _count_outliers(df: DataFrame, summaries: list[NumericSummary]) -> None:
    known = [s for s in summaries if s.fences is not None]
    if not known:
        return
    counts = []
    for i, s in enumerate(known):
        v = number(df, s.column)
        low, high = s.fences
        outside = (v < low) | (v > high)
        counts.append(F.count_if(outside).alias(f"i{i}"))
        far = (
            F.abs(v - F.lit(s.mean)) / F.lit(s.std_pop) > 3.0 if s.std_pop else F.lit(False)
        )
        counts.append(F.count_if(outside & far).alias(f"b{i}"))
    row = df.agg(*counts).first()
    for i, s in enumerate(known):
        s.iqr_outliers, s.both_outliers = row[f"i{i}"], row[f"b{i}"]


def missing_counts(df: DataFrame) -> DataFrame:
    """``(position, column, total, missing)`` per column from one scan."""
    return per_column(
        df,
        df.columns,
        lambda c: [
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_missing(df, c)).alias("missing"),
        ],
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, column kinds."""
    counts, copies = together(
        df.sparkSession,
        lambda: localize(missing_counts(df)),
        lambda: count_duplicate_rows(df),
    )
    cells = counts.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"),
    )
    return cells.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "missing_values",
        F.lit(copies).cast("bigint").alias("duplicates"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("text_columns"),
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, distinct values, nulls and, for numbers, min, max, mean and sample deviation.

    Distinct values are counted exactly through the value-frequency table, which
    shuffles each distinct value once; ``approximate`` replaces that by a sketch within
    the same scan.
    """
    numbers = set(numeric_columns(df))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def stats(c):
        v = number(df, c) if c in numbers else F.lit(None).cast("double")
        sketch = F.approx_count_distinct(v if c in numbers else ref(c)) if approximate else F.lit(0)
        return [
            F.lit(kinds[c]).alias("data_type"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_missing(df, c)).alias("null_count"),
            F.min(v).alias("minimum"),
            F.max(v).alias("maximum"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            sketch.cast("bigint").alias("sketched"),
        ]

    base = per_column(df, df.columns, stats)
    if approximate:
        base = base.withColumnRenamed("sketched", "unique_values")
    else:
        distinct = distinct_counts(df, df.columns)
        base = base.drop("sketched").join(distinct, "column", "left")
    return base.select(
        "position",
        "column",
        "data_type",
        F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"),
        "null_count",
        percent(F.col("null_count"), F.col("total")).alias("null_percentage"),
        "minimum",
        "maximum",
        "mean",
        "std",
    )


def column_samples(df: DataFrame, count: int = 5) -> DataFrame:
    """The smallest distinct non-null values of each column as strings.

    One scan: a task keeps the ``count`` smallest values of every column and hands over
    only these, and the tasks' few rows are merged. Deviation: the smallest instead of the
    first seen, since rows have no order here.
    """
    texts = [F.when(~is_missing(df, c), ref(c).cast("string")).alias(f"c{i}") for i, c in enumerate(df.columns)]

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pa.Array] = {}
        for batch in batches:
            for i, values in enumerate(batch.columns):
                values = values.drop_null()
                best = kept.get(i)
                if best is not None and len(best) >= count:
                    values = values.filter(pc.less(values, best[-1]))
                if len(values):
                    values = pc.unique(values if best is None else pa.concat_arrays([best, values]))
                    kept[i] = values.take(pc.sort_indices(values))[:count]
        at = [i for i, v in kept.items() for _ in v]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.concat_arrays([pa.array([], pa.string()), *(v.cast(pa.string()) for v in kept.values())])],
            ["at", "value"],
        )

    if not texts:
        return small_frame(df.sparkSession, [], "column string, rank bigint, value string")
    found = df.select(*texts).mapInArrow(smallest, "at int, value string").distinct()
    place = F.row_number().over(Window.partitionBy("at").orderBy("value"))  # a few rows of each task
    ranked = found.select("at", "value", place.cast("bigint").alias("rank")).where(F.col("rank") <= count)
    names = F.array(*[F.lit(c) for c in df.columns])
    return ranked.select(F.get(names, F.col("at")).alias("column"), "rank", "value")


def iqr_outlier_counts(df: DataFrame) -> DataFrame:
    """Rows outside the quartile fences per numeric column, without further guards."""
    rows = [(s.column, int(s.iqr_outliers)) for s in summarize_numeric(df)]
    return small_frame(df.sparkSession, rows, "column string, outliers bigint")


def profile_summary(df: DataFrame) -> DataFrame:
    """Missing share over all cells, duplicate share, outliers of all columns."""
    stats, summaries = together(
        df.sparkSession, lambda: dataset_stats(df).first(), lambda: summarize_numeric(df)
    )
    outliers = sum(s.iqr_outliers for s in summaries)
    rows, cols = stats["total_rows"], stats["total_columns"]
    out = [
        (
            rows,
            cols,
            100.0 * stats["missing_values"] / (rows * cols) if rows * cols else 0.0,
            100.0 * stats["duplicates"] / rows if rows else 0.0,
            outliers,
        )
    ]
    return small_frame(
        df.sparkSession,
        out,
        "total_rows bigint, total_columns bigint, missing_percentage double, "
        "duplicate_percentage double, total_outliers bigint",
    )
