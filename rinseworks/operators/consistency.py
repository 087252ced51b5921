"""Mixed formats, whitespace, character set, case and encoding defects of text columns.

All tests that look at one value at a time share a single scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import localize, per_column
from rinseworks.functions import constants as K
from rinseworks.functions.expr import contains_any, percent, ref, severity, strip, text_columns
from rinseworks.operators.frequency import compact, stacked_text

_FORMATS = list(K.DATE_FORMATS)


def format_counts(df: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Per text column, how many values show each of the tested traits.

    ``wanted`` names the start of the traits to test; the others stay zero.
    """

    def stats(c):
        v = ref(c)
        marks = F.count_if(contains_any(v, K.MOJIBAKE))
        if c.lower() in K.ASCII_ONLY_COLUMNS:
            marks = marks + F.count_if(v.rlike(K.NON_ASCII))
        traits = {
            **{f"date{i}": v.rlike(p) for i, p in enumerate(K.DATE_FORMATS.values())},
            "comma": v.rlike(K.COMMA_DECIMAL),
            "dot": v.rlike(K.DOT_DECIMAL),
            "currency": v.rlike(K.CURRENCY_SYMBOL),
            "whitespace": strip(v) != v,
            "non_ascii": v.rlike(K.NON_ASCII),
        }
        counts = {name: F.count_if(test) for name, test in traits.items()} | {"encoding": marks}
        return [
            F.count(v).alias("present"),
            *[
                (n if wanted is None or name.startswith(wanted) else F.lit(0).cast("bigint")).alias(name)
                for name, n in counts.items()
            ],
        ]

    return per_column(df, text_columns(df), stats)


def _issue(kind: str, rows, level, text: str):
    return [
        F.lit(kind).alias("issue_type"),
        "column",
        rows.cast("bigint").alias("affected_rows"),
        percent(rows, F.col("present")).alias("percentage"),
        (F.lit(level) if isinstance(level, str) else level).alias("severity"),
        F.format_string(text, F.col("column"), rows.cast("bigint")).alias("description"),
    ]


def mixed_date_formats(counts: DataFrame) -> DataFrame:
    hits = [F.col(f"date{i}") for i in range(len(_FORMATS))]
    kinds = sum(((h > 0).cast("int") for h in hits), F.lit(0))
    rows = sum(hits, F.lit(0))
    return counts.where(kinds > 1).select(
        *_issue("inconsistent_date_format", rows, "medium", "Column '%s' mixes date formats in %d values")
    )


def mixed_decimal_separator(counts: DataFrame) -> DataFrame:
    rows = F.col("comma") + F.col("dot")
    return counts.where((F.col("comma") > 0) & (F.col("dot") > 0)).select(
        *_issue(
            "inconsistent_decimal_separator", rows, "medium",
            "Column '%s' mixes comma and dot decimals in %d values",
        )
    )


def currency_symbols(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("currency") > 0).select(
        *_issue("currency_in_numeric", F.col("currency"), "low", "Column '%s' has currency symbols in %d values")
    )


def outer_whitespace(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("whitespace") > 0).select(
        *_issue(
            "leading_trailing_whitespace", F.col("whitespace"), "low",
            "Column '%s' has leading or trailing whitespace in %d values",
        )
    )


def non_ascii_characters(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("non_ascii") > 0).select(
        *_issue("non_ascii_characters", F.col("non_ascii"), "low", "Column '%s' has non-ASCII characters in %d values")
    )


def encoding_issues(counts: DataFrame) -> DataFrame:
    rows = F.col("encoding")
    return counts.where(rows > 0).select(
        *_issue("encoding_issues", rows, severity(rows, None, 10), "Column '%s' has %d encoding issues")
    )


def detect_mixed_date_formats(df: DataFrame) -> DataFrame:
    """Deviation: every value is looked at, not the first hundred."""
    return mixed_date_formats(format_counts(df, ("date",)))


def detect_mixed_decimal_separator(df: DataFrame) -> DataFrame:
    return mixed_decimal_separator(format_counts(df, ("comma", "dot")))


def detect_currency_symbols(df: DataFrame) -> DataFrame:
    return currency_symbols(format_counts(df, ("currency",)))


def detect_whitespace(df: DataFrame) -> DataFrame:
    return outer_whitespace(format_counts(df, ("whitespace",)))


def detect_non_ascii(df: DataFrame) -> DataFrame:
    return non_ascii_characters(format_counts(df, ("non_ascii",)))


def detect_encoding_issues(df: DataFrame) -> DataFrame:
    return encoding_issues(format_counts(df, ("encoding",)))


def case_variants(df: DataFrame) -> DataFrame:
    """``(column, folded, variants, rows)``: spellings that differ only in case."""
    value = F.col("value")
    return (
        stacked_text(df, text_columns(df))
        .where(value.isNotNull())
        .groupBy(
            "column", compact(F.lower(value)).alias("folded"), compact(value).alias("value")
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("column", "folded")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("cnt").alias("rows"))
    )


def detect_inconsistent_case(df: DataFrame) -> DataFrame:
    """Columns holding spellings that differ only in case; counts spellings, not rows."""
    per = (
        case_variants(df)
        .groupBy("column")
        .agg(
            F.sum("variants").alias("present"),
            F.sum(F.when(F.col("variants") > 1, F.col("variants"))).alias("affected"),
        )
    )
    return per.where(F.col("affected") > 0).select(
        *_issue(
            "inconsistent_case", F.col("affected"), "low",
            "Column '%s' has %d values with inconsistent case",
        )
    )


def detect_inconsistencies(df: DataFrame) -> DataFrame:
    """All format, whitespace, character and case issues, in a fixed order."""
    counts = localize(format_counts(df))
    steps = [
        mixed_date_formats(counts),
        mixed_decimal_separator(counts),
        currency_symbols(counts),
        outer_whitespace(counts),
        non_ascii_characters(counts),
        detect_inconsistent_case(df),
    ]
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out
