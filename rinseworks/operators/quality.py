"""The 0-100 quality score: issues with deductions, summary, labels, recommendations.

These thresholds differ from those of the detectors on purpose; both are part of the
contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import localize, per_column, small_frame, together
from rinseworks.functions import constants as K
from rinseworks.functions.expr import (
    at_most,
    is_missing,
    numeric_columns,
    percent,
    ref,
    severity,
    strip,
    text_columns,
)
from rinseworks.operators.consistency import case_variants
from rinseworks.operators.duplicates import duplicate_row_count
from rinseworks.operators.frequency import SHORT, compact, stacked_text
from rinseworks.operators.profile import NumericSummary, missing_counts, summarize_numeric

_TEXT_COUNTS = ["missing", "present", "spaced", "bad_email", "bad_phone", "empty", "numeric"]


def _text_tests(v: Column, name: Column) -> dict[str, Column]:
    """What is wrong with one text value; ``name`` is the name of its column."""
    return {
        "missing": v.isNull() | strip(v).isin("", "nan"),
        "present": v.isNotNull(),
        "spaced": v.startswith(" ") | v.endswith(" "),
        "bad_email": F.contains(F.lower(name), F.lit("email")) & ~v.rlike(K.VALID_EMAIL),
        "bad_phone": F.contains(F.lower(name), F.lit("phone")) & ~v.rlike(K.VALID_PHONE),
        "empty": v == "",
        "numeric": v.rlike(K.NUMERIC_LITERAL),
    }


def quality_counts(df: DataFrame) -> DataFrame:
    """Per column the counts behind all one-value-at-a-time issues, in one scan."""
    texts = set(text_columns(df))

    def stats(c):
        tests = _text_tests(ref(c), F.lit(c)) if c in texts else {"missing": is_missing(df, c)}
        counts = {name: F.count_if(test) for name, test in tests.items()}
        return [
            F.count(F.lit(1)).alias("total"),
            *[counts.get(n, F.lit(0).cast("bigint")).alias(n) for n in _TEXT_COUNTS],
        ]

    return per_column(df, df.columns, stats)


def text_quality_counts(df: DataFrame) -> DataFrame:
    """The same counts for text columns with ``distinct`` and ``folded`` spellings.

    Built on the value-frequency table: a short value is tested once however often it
    occurs. Long text is tested where it is read and travels as a digest with the
    outcome of its tests.
    """
    value, name = F.col("value"), F.col("column")
    here = F.array(*[F.coalesce(t, F.lit(False)) for t in _text_tests(value, name).values()])
    counted = (
        stacked_text(df, text_columns(df))
        .groupBy(
            "column",
            compact(F.lower(value)).alias("folded"),
            compact(value).alias("value"),
            F.when(F.length(value) > SHORT, here).alias("tested"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("tests", F.coalesce("tested", here))
    )
    per_spelling = counted.groupBy("column", "folded").agg(
        F.count("value").alias("variants"),
        F.sum("cnt").alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("tests")[i], F.col("cnt"))), F.lit(0)).alias(n)
            for i, n in enumerate(_TEXT_COUNTS)
        ],
    )
    return per_spelling.groupBy("column").agg(
        F.sum("variants").alias("distinct"),
        F.count("folded").alias("folded"),
        *[F.sum(n).alias(n) for n in ("total", *_TEXT_COUNTS)],
    )


def _issues(
    counts: DataFrame, kind: str, rows: Column, whole: Column, level, deduction, text: str
) -> DataFrame:
    share = percent(rows, whole)
    return counts.where(rows > 0).select(
        F.lit(kind).alias("issue_type"),
        F.col("column"),
        rows.cast("bigint").alias("affected_rows"),
        F.round(share, 2).alias("percentage"),
        (F.lit(level) if isinstance(level, str) else level(share)).alias("severity"),
        F.format_string(text, F.col("column"), rows.cast("bigint"), share).alias("description"),
        deduction(share).alias("deduction"),
    )


def missing_issues(counts: DataFrame) -> DataFrame:
    """Null, blank or the word ``nan``; both halves of the deduction apply."""
    return _issues(
        counts, "missing_values", F.col("missing"), F.col("total"),
        lambda p: severity(p, 30, 10),
        lambda p: at_most(p * 0.5, 25) + at_most(p * 0.5, 15),
        "Column '%s' has %d missing values (%.1f%%)",
    )


def duplicate_issues(counts: DataFrame) -> DataFrame:
    return _issues(
        counts.withColumn("column", F.lit("all_columns")), "duplicates",
        F.col("duplicates"), F.col("total_rows"),
        lambda p: severity(p, 10, 5),
        lambda p: at_most(p * 0.8, 20),
        "Rows in %s: %d duplicates (%.1f%%)",
    )


def outlier_issues(df: DataFrame, summaries: list[NumericSummary]) -> DataFrame:
    """Quartile-fence outliers of columns with more than three values and a spread."""
    rows = [
        (s.column, int(s.iqr_outliers), s.present)
        for s in summaries
        if s.present > 3 and s.q3 - s.q1 > 0
    ]
    counts = small_frame(df.sparkSession, rows, "column string, outliers bigint, present bigint")
    return _issues(
        counts, "outliers", F.col("outliers"), F.col("present"),
        lambda p: severity(p, None, 5),
        lambda p: at_most(p * 0.3, 10),
        "Column '%s' has %d outliers (%.1f%%)",
    )


def whitespace_issues(counts: DataFrame) -> DataFrame:
    return _issues(
        counts, "whitespace", F.col("spaced"), F.col("present"), "low",
        lambda p: at_most(p * 0.2, 5),
        "Column '%s' has %d values with outer spaces (%.1f%%)",
    )


def case_counts(df: DataFrame) -> DataFrame:
    """``(column, distinct, folded)``: spellings before and after lower-casing."""
    return (
        case_variants(df)
        .groupBy("column")
        .agg(F.sum("variants").alias("distinct"), F.count(F.lit(1)).alias("folded"))
    )


def case_issues(counts: DataFrame) -> DataFrame:
    surplus = F.col("distinct") - F.col("folded")
    return _issues(
        counts, "case_inconsistency", surplus, F.col("distinct"), "low",
        lambda p: at_most(surplus * 0.5, 8),
        "Column '%s' has %d case variations (%.1f%%)",
    )


def email_issues(counts: DataFrame) -> DataFrame:
    return _issues(
        counts, "invalid_email_format", F.col("bad_email"), F.col("present"), "high",
        lambda p: at_most(p * 0.8, 15),
        "Column '%s' has %d invalid e-mail addresses (%.1f%%)",
    )


def phone_issues(counts: DataFrame) -> DataFrame:
    return _issues(
        counts, "invalid_phone_format", F.col("bad_phone"), F.col("present"), "medium",
        lambda p: at_most(p * 0.6, 12),
        "Column '%s' has %d invalid phone numbers (%.1f%%)",
    )


def empty_string_issues(counts: DataFrame) -> DataFrame:
    return _issues(
        counts, "empty_strings", F.col("empty"), F.col("present"), "medium",
        lambda p: at_most(p * 0.4, 10),
        "Column '%s' has %d empty strings (%.1f%%)",
    )


def numeric_text_issues(counts: DataFrame) -> DataFrame:
    """Text columns in which more than four fifths of the values are numbers."""
    mostly = counts.where(F.col("numeric") > F.col("present") * 0.8)
    return _issues(
        mostly, "data_type_mismatch", F.col("numeric"), F.col("present"), "medium",
        lambda p: F.lit(5.0),
        "Column '%s' holds %d numbers as text (%.1f%%)",
    )


def auto_missing(df: DataFrame) -> DataFrame:
    return missing_issues(quality_counts(df))


def auto_duplicates(df: DataFrame) -> DataFrame:
    return duplicate_issues(duplicate_row_count(df))


def auto_outliers(df: DataFrame) -> DataFrame:
    return outlier_issues(df, summarize_numeric(df))


def auto_whitespace(df: DataFrame) -> DataFrame:
    return whitespace_issues(quality_counts(df))


def auto_case(df: DataFrame) -> DataFrame:
    return case_issues(case_counts(df))


def auto_invalid_email(df: DataFrame) -> DataFrame:
    return email_issues(quality_counts(df))


def auto_invalid_phone(df: DataFrame) -> DataFrame:
    return phone_issues(quality_counts(df))


def auto_empty_strings(df: DataFrame) -> DataFrame:
    return empty_string_issues(quality_counts(df))


def auto_numeric_as_text(df: DataFrame) -> DataFrame:
    return numeric_text_issues(quality_counts(df))


def analyze_quality(df: DataFrame) -> DataFrame:
    """All quality issues of a table with their deductions.

    Text is tested on the value-frequency table, numbers in the scans the quartiles
    need anyway, duplicates on row hashes; the issues themselves are a handful of rows.
    """
    rest = [c for c in df.columns if c not in {*numeric_columns(df), *text_columns(df)}]
    texts, duplicates, summaries, gaps = together(
        df.sparkSession,
        lambda: localize(text_quality_counts(df)),
        lambda: localize(duplicate_row_count(df)),
        lambda: summarize_numeric(df),
        lambda: missing_counts(df.select(*[ref(c) for c in rest])).collect() if rest else [],
    )
    known = {s.column: (s.rows, s.rows - s.present) for s in summaries}
    known.update({r["column"]: (r["total"], r["missing"]) for r in gaps})
    others = small_frame(
        df.sparkSession,
        [(c, n, m) for c, (n, m) in known.items()],
        "column string, total bigint, missing bigint",
    )
    parts = [
        missing_issues(texts.select("column", "total", "missing").unionByName(others)),
        duplicate_issues(duplicates),
        outlier_issues(df, summaries),
        whitespace_issues(texts),
        case_issues(texts),
        email_issues(texts),
        phone_issues(texts),
        empty_string_issues(texts),
        numeric_text_issues(texts),
    ]
    return reduce(DataFrame.unionByName, parts)


def score(issues: DataFrame) -> DataFrame:
    """One row: score, sum of deductions, issues in total and by severity."""
    total = F.coalesce(F.sum("deduction"), F.lit(0.0))
    return issues.agg(
        F.round(F.greatest(F.lit(0.0), 100.0 - total), 1).alias("quality_score"),
        F.round(total, 2).alias("quality_deductions"),
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("severity") == "medium").alias("medium_severity"),
        F.count_if(F.col("severity") == "low").alias("low_severity"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    return score(analyze_quality(df))


def profile_to_analysis(df: DataFrame) -> DataFrame:
    """Issues derived from a profile alone: plain nulls, duplicates, outliers per row."""
    missing = missing_counts(df)
    duplicates = duplicate_row_count(df)
    rows = [(s.column, int(s.iqr_outliers), s.rows) for s in summarize_numeric(df)]
    outliers = small_frame(
        df.sparkSession,
        rows, "column string, outliers bigint, total bigint"
    )
    parts = [
        missing_issues(missing),
        duplicate_issues(duplicates),
        _issues(
            outliers, "outliers", F.col("outliers"), F.col("total"),
            lambda p: severity(p, None, 5),
            lambda p: at_most(p * 0.3, 10),
            "Column '%s' has %d outliers (%.1f%%)",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def recommendations(issues: DataFrame) -> DataFrame:
    """One recommended step per issue that has one."""
    kind, share = F.col("issue_type"), F.col("percentage")
    advice = (
        F.when((kind == "missing_values") & (share > 70), "drop_column")
        .when((kind == "missing_values") & (share > 30), "advanced_imputation")
        .when(kind == "missing_values", "simple_imputation")
        .when(kind == "duplicates", "drop_duplicates")
        .when((kind == "outliers") & (share > 10), "cap_outliers")
        .when(kind == "outliers", "remove_outliers")
        .when(kind == "case_inconsistency", "normalize_case")
        .when(kind == "whitespace", "trim_whitespace")
    )
    return issues.select("issue_type", "column", advice.alias("recommendation")).where(
        F.col("recommendation").isNotNull()
    )


def issue_labels(issues: DataFrame) -> DataFrame:
    """Coarse labels of what was found, or the one that says nothing was."""
    kind = F.col("issue_type")
    label = (
        F.when(kind == "missing_values", "Missing Values Detected")
        .when(kind == "duplicates", "Duplicate Rows Found")
        .when(kind == "outliers", "Statistical Outliers Present")
        .when(kind.isin("whitespace", "case_inconsistency", "empty_strings",
                        "invalid_email_format", "invalid_phone_format"), "Text Quality Issues")
    )
    found = issues.select(label.alias("label")).where(F.col("label").isNotNull())
    return found.agg(F.collect_set("label").alias("labels")).select(
        F.explode(
            F.when(F.size("labels") > 0, F.col("labels")).otherwise(
                F.array(F.lit("No Major Issues Detected"))
            )
        ).alias("label")
    )


def severity_breakdown(issues: DataFrame) -> DataFrame:
    """Issues per severity, gravest first."""
    order = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return (
        issues.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("issues"))
        .orderBy(order)
    )


def missing_ranking(df: DataFrame) -> DataFrame:
    """Columns with missing values by their share, least first."""
    counts = quality_counts(df)
    return (
        counts.where(F.col("missing") > 0)
        .select(
            "column",
            "missing",
            percent(F.col("missing"), F.col("total")).alias("missing_percentage"),
        )
        .orderBy("missing_percentage", "column")
    )


def quality_band(value: Column) -> Column:
    return (
        F.when(value >= 95, "excellent")
        .when(value >= 85, "good")
        .when(value >= 70, "fair")
        .otherwise("needs attention")
    )


def quality_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row comparing two tables: scores, improvement, band, shapes, issues.

    The improvement is measured against the table before, not against a constant.
    """
    b, a, rows_before, rows_after = together(
        before.sparkSession,
        lambda: quality_score(before).first(),
        lambda: quality_score(after).first(),
        before.count,
        after.count,
    )
    found = b["total_issues"]
    success = 100.0 * (found - a["total_issues"]) / found if found else 100.0
    row = [
        (
            b["quality_score"], a["quality_score"], a["quality_score"] - b["quality_score"],
            rows_before, rows_after, rows_before - rows_after,
            len(before.columns), len(after.columns), found, a["total_issues"], success,
        )
    ]
    schema = (
        "before_score double, after_score double, improvement double, rows_before bigint, "
        "rows_after bigint, rows_removed bigint, columns_before bigint, columns_after bigint, "
        "issues_before bigint, issues_after bigint, success_percentage double"
    )
    return small_frame(before.sparkSession, row, schema).withColumn(
        "band", quality_band(F.col("after_score"))
    )
