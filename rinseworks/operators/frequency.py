"""The value-frequency table: how often each column holds each value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import small_frame
from rinseworks.functions.expr import ref


# Longer texts are told apart by their SHA-256. Its text form is longer than any value
# that stands for itself, so the two cannot be mixed up.
SHORT = 64


def compact(value: Column) -> Column:
    """The value, or for long text its digest: grouping then shuffles no long text."""
    digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
    return F.when(F.length(value) > SHORT, digest).otherwise(value)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, cnt)`` over the given columns, nulls included, long text compacted.

    One shuffle of partial counts serves distinct counts, repeated values and rare
    categories of all columns at once; a value that fills a third of the table arrives
    as one partial count per task.
    """
    if not columns:
        return small_frame(df.sparkSession, [], "column string, value string, cnt bigint")
    return (
        stacked_text(df, columns)
        .groupBy("column", compact(F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def stacked_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)``: one row per cell of the given columns, as text."""
    if not columns:
        return small_frame(df.sparkSession, [], "column string, value string")
    texts = df.select(*[ref(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], [ref(c) for c in columns], "column", "value")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, unique_values)`` of non-missing values, exact.

    Columns are stacked by kind in their own type, so numbers are grouped as numbers.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema:
        if f.name in columns:
            kinds.setdefault(_stack_type(f.dataType), []).append(f.name)
    parts = []
    for kind, names in kinds.items():
        native = df.select(*[ref(c).cast(kind).alias(c) for c in names])
        stacked = native.unpivot([], [ref(c) for c in names], "column", "value")
        if kind == "string":
            stacked = stacked.withColumn("value", compact(F.col("value")))
        present = F.col("value").isNotNull()
        if kind == "double":
            present = present & ~F.isnan("value")
        parts.append(
            stacked.where(present)
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("unique_values"))
        )
    return reduce(DataFrame.unionByName, parts)


def _stack_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    return "string"


def column_mode(df: DataFrame, value: Column) -> object:
    """The most frequent non-null value, the smallest among equals; ``None`` if empty.

    Counts are combined map-side, then one running minimum picks the winner.
    """
    row = (
        df.select(value.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .agg(F.min_by("value", F.struct((-F.col("cnt")).alias("c"), F.col("value"))).alias("m"))
        .first()
    )
    return row["m"]
