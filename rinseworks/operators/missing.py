"""Missing-value detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.functions.expr import is_missing, percent, severity
from rinseworks.operators.profile import missing_counts


def detect_missing(df: DataFrame) -> DataFrame:
    """One issue per column with missing values; strict limits at 50 and 20 percent."""
    share = percent(F.col("missing"), F.col("total"))
    return (
        missing_counts(df)
        .where(F.col("missing") > 0)
        .orderBy("position")
        .select(
            F.lit("missing_values").alias("issue_type"),
            "column",
            F.col("missing").alias("affected_rows"),
            share.alias("percentage"),
            severity(share, 50, 20).alias("severity"),
            F.format_string(
                "Column '%s' has %d missing values (%.1f%%)", F.col("column"), F.col("missing"), share
            ).alias("description"),
        )
    )


def detect_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value."""
    return (
        missing_counts(df)
        .where((F.col("missing") == F.col("total")) & (F.col("total") > 0))
        .select(
            F.lit("empty_column").alias("issue_type"),
            "column",
            F.col("total").alias("affected_rows"),
            F.lit(100.0).alias("percentage"),
            F.lit("high").alias("severity"),
            F.format_string("Column '%s' is empty", F.col("column")).alias("description"),
        )
    )


def detect_mostly_empty_rows(df: DataFrame, limit: float = 0.8) -> DataFrame:
    """Rows in which more than the given share of the cells is missing."""
    empty = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    share = percent(F.col("rows"), F.col("total"))
    return (
        df.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(empty / F.lit(float(len(df.columns))) > limit).alias("rows"),
        )
        .where(F.col("rows") > 0)
        .select(
            F.lit("mostly_empty_rows").alias("issue_type"),
            F.lit(None).cast("string").alias("column"),
            F.col("rows").alias("affected_rows"),
            share.alias("percentage"),
            F.lit("medium").alias("severity"),
            F.format_string("Found %d mostly empty rows", F.col("rows")).alias("description"),
        )
    )
