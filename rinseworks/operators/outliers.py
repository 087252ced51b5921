"""Numeric outliers by quartile fences and z-scores, and rare categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import small_frame
from rinseworks.functions.expr import number, percent, text_columns
from rinseworks.operators.frequency import value_counts
from rinseworks.operators.profile import NumericSummary, summarize_numeric
from rinseworks.operators.quantiles import exact_quantiles
from rinseworks.types import ISSUE_SCHEMA


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> tuple[float, float] | None:
    q = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if q is None:
        return None
    return q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])


def iqr_flags(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences of a column."""
    bounds = iqr_bounds(df, column, k)
    if bounds is None:
        return df.limit(0)
    v = number(df, column)
    return df.where((v < bounds[0]) | (v > bounds[1]))


def zscore_flags(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` population deviations from the mean."""
    v = number(df, column)
    mean, std = df.agg(F.avg(v), F.stddev_pop(v)).first()
    if not std:
        return df.limit(0)
    return df.where(F.abs(v - F.lit(mean)) / F.lit(std) > threshold)


def numeric_outlier_issues(summaries: list[NumericSummary]) -> list[tuple]:
    """Issue rows for columns at most half missing; both rules must flag a row."""
    rows = []
    for s in summaries:
        if s.rows == 0 or (s.rows - s.present) / s.rows > 0.5 or s.both_outliers == 0:
            continue
        share = 100.0 * s.both_outliers / s.rows
        level = "high" if share > 10 else "medium" if share > 5 else "low"
        text = f"Column '{s.column}' has {s.both_outliers} outliers ({share:.1f}%)"
        rows.append(("numeric_outliers", s.column, int(s.both_outliers), share, level, text))
    return rows


def detect_numeric_outliers(df: DataFrame) -> DataFrame:
    return small_frame(
        df.sparkSession,
        numeric_outlier_issues(summarize_numeric(df)), ISSUE_SCHEMA
    )


def detect_rare_categories(df: DataFrame, limit: float = 0.01) -> DataFrame:
    """Text values that make up less than one percent of the non-null values."""
    counts = value_counts(df, text_columns(df)).where(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("cnt").alias("total"))
    rare = (
        counts.join(F.broadcast(totals), "column")  # one row per column
        .where(F.col("cnt") / F.col("total") < limit)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("categories"),
            F.sum("cnt").alias("rows"),
            F.max("total").alias("total"),
        )
    )
    return rare.select(
        F.lit("rare_categories").alias("issue_type"),
        "column",
        F.col("rows").alias("affected_rows"),
        percent(F.col("rows"), F.col("total")).alias("percentage"),
        F.lit("low").alias("severity"),
        F.format_string(
            "Column '%s' has %d rare categories affecting %d rows",
            F.col("column"), F.col("categories"), F.col("rows"),
        ).alias("description"),
    )
