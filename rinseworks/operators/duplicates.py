"""Exact, per-column and normalised duplicates; fingerprints of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.functions.expr import integer_columns, percent, ref, severity, strip, text_columns
from rinseworks.operators.frequency import value_counts


def row_digest(df: DataFrame) -> Column:
    """A 256-bit digest of the row, the same for rows that ``groupBy`` takes for equal.

    Each value is written with its length, so that no two rows share an encoding; a null
    has none. Both zeros of a floating-point column are one value.
    """
    parts = []
    for f in df.schema:
        value = ref(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = value.cast("double") + 0.0
        elif isinstance(f.dataType, T.TimestampType):
            value = F.unix_micros(value)  # as text, two instants of a clock set back would be one
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts) if parts else F.lit(""), 256))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row: total rows and surplus copies.

    One scan; copies are counted by digest where they are read, and the shuffle carries 32
    bytes for a distinct row, whatever its width.
    """
    kinds = df.groupBy(row_digest(df).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def count_duplicate_rows(df: DataFrame) -> int:
    """Rows minus distinct rows."""
    return duplicate_row_count(df).first()["duplicates"]


def detect_exact_duplicates(df: DataFrame) -> DataFrame:
    share = percent(F.col("duplicates"), F.col("total_rows"))
    return (
        duplicate_row_count(df)
        .where(F.col("duplicates") > 0)
        .select(
            F.lit("exact_duplicates").alias("issue_type"),
            F.lit(None).cast("string").alias("column"),
            F.col("duplicates").alias("affected_rows"),
            share.alias("percentage"),
            severity(share, 10, 5).alias("severity"),
            F.format_string(
                "Found %d exact duplicate rows (%.1f%%)", F.col("duplicates"), share
            ).alias("description"),
        )
    )


def detect_column_duplicates(df: DataFrame) -> DataFrame:
    """Text and integer columns that repeat values, unless almost everything repeats."""
    columns = [c for c in df.columns if c in set(text_columns(df)) | set(integer_columns(df))]
    per = (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.sum("cnt").alias("total"), F.sum(F.col("cnt") - 1).alias("repeats"))
    )
    return per.where((F.col("repeats") > 0) & (F.col("repeats") < F.col("total") * 0.8)).select(
        F.lit("column_duplicates").alias("issue_type"),
        "column",
        F.col("repeats").alias("affected_rows"),
        percent(F.col("repeats"), F.col("total")).alias("percentage"),
        F.lit("low").alias("severity"),
        F.format_string(
            "Column '%s' has %d repeated values", F.col("column"), F.col("repeats")
        ).alias("description"),
    )


def detect_normalized_duplicates(df: DataFrame) -> DataFrame:
    """Values that coincide after lower-casing and stripping.

    Deviation: nulls are left out instead of being counted as the word ``nan``.
    """
    per = (
        _normalized(df)
        .where(F.col("cnt") > 1)
        .groupBy("column")
        .agg(F.sum(F.col("cnt") - 1).alias("repeats"), F.sum("cnt").alias("rows"))
    )
    return per.select(
        F.lit("normalized_duplicates").alias("issue_type"),
        "column",
        F.col("repeats").alias("affected_rows"),
        percent(F.col("repeats"), F.col("rows")).alias("percentage"),
        F.lit("low").alias("severity"),
        F.format_string(
            "Column '%s' has %d values equal after normalisation", F.col("column"), F.col("repeats")
        ).alias("description"),
    )


def _normalized(df: DataFrame) -> DataFrame:
    texts = df.select(*[F.lower(strip(ref(c))).alias(c) for c in text_columns(df)])
    return value_counts(texts, text_columns(df)).where(F.col("value").isNotNull())


def content_fingerprint(df: DataFrame, key: str, content: str) -> DataFrame:
    """SHA-256 of each content with its first key and number of copies."""
    return (
        df.select(ref(key).alias("key"), F.sha2(ref(content), 256).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
    )


def drop_duplicates(df: DataFrame, keep: str | bool = "first") -> DataFrame:
    """Keep one of each group of equal rows, or with ``keep=False`` none of them.

    Equal rows are indistinguishable, so first and last give the same table.
    """
    if keep in ("first", "last"):
        return df.dropDuplicates()
    columns = [ref(c) for c in df.columns]
    return (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == 1).drop("__n")
    )
