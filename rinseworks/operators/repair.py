"""Repairs without a model: dropping, capping, transforming and text normalisation.

Every repair returns a lazy frame; the bounds it needs are a few aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.functions.expr import (
    is_missing,
    number,
    numeric_columns,
    ref,
    strip,
    text_columns,
    title,
)
from rinseworks.operators.outliers import iqr_bounds
from rinseworks.operators.profile import missing_counts, summarize_numeric
from rinseworks.operators.quality import case_counts
from rinseworks.operators.quantiles import exact_quantiles


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_missing(df, column))


def drop_sparse_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Keep rows in which at least the given share of the cells (rounded down) is filled."""
    filled = sum(((~is_missing(df, c)).cast("int") for c in df.columns), F.lit(0))
    return df.where(filled >= int(len(df.columns) * share))


def sparse_columns(df: DataFrame, limit: float = 70.0) -> list[str]:
    rows = missing_counts(df).collect()
    return [r["column"] for r in rows if r["total"] and 100.0 * r["missing"] / r["total"] > limit]


def drop_sparse_columns(df: DataFrame, limit: float = 70.0) -> DataFrame:
    """Drop columns missing in more than the given percentage of the rows."""
    return df.drop(*sparse_columns(df, limit))


def remove_outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """Keep rows within the quartile fences; rows without a value go as well."""
    bounds = iqr_bounds(df, column)
    if bounds is None:
        return df.limit(0)
    return df.where(number(df, column).between(*bounds))


def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    v = number(df, column)
    return df.withColumn(
        column, F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))
    )


def cap_outliers_percentile(
    df: DataFrame, column: str, lower: float = 0.05, upper: float = 0.95
) -> DataFrame:
    bounds = exact_quantiles(df, [column], [lower, upper])[column]
    return df if bounds is None else clip(df, column, *bounds)


def cap_outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    bounds = iqr_bounds(df, column)
    return df if bounds is None else clip(df, column, *bounds)


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """``log1p``, shifted to start at one where the smallest value is not positive."""
    v = number(df, column)
    least = df.agg(F.min(v)).first()[0]
    shifted = v - F.lit(least) + 1.0 if least is not None and least <= 0 else v
    return df.withColumn(column, F.log1p(shifted))


def convert_case(df: DataFrame, column: str, style: str) -> DataFrame:
    """``lowercase``, ``uppercase`` or ``title_case``. Deviation: null stays null."""
    return df.withColumn(column, cased(ref(column), style))


def cased(value: Column, style: str) -> Column:
    return {"lowercase": F.lower, "uppercase": F.upper, "title_case": title}[style](value)


def strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    """Deviation: null stays null."""
    return df.withColumn(column, strip(ref(column)))


def normalize_text_columns(df: DataFrame) -> DataFrame:
    """Strip all text columns, then title-case those with many case variants."""
    texts = text_columns(df)
    if not texts:
        return df
    stripped = df.withColumns({c: strip(ref(c)) for c in texts})
    mixed = [
        r["column"]
        for r in case_counts(stripped).collect()  # one row per column
        if r["folded"] < r["distinct"] * 0.8
    ]
    return stripped.withColumns({c: title(ref(c)) for c in mixed}) if mixed else stripped


def adaptive_outliers(df: DataFrame, cut_lineage: bool = True) -> tuple[DataFrame, list[tuple]]:
    """Cap columns with many outliers, drop the rows of few, leave the band between.

    Columns are handled in order and see the rows earlier columns left. The bounds of
    all remaining columns come from one fused summary, renewed only after rows were
    really removed. Returns the frame and ``(column, action, rows)``.
    """
    waiting = numeric_columns(df)
    actions: list[tuple] = []
    summaries = {s.column: s for s in summarize_numeric(df, waiting)}
    while waiting:
        column = waiting.pop(0)
        s = summaries[column]
        if s.present <= 10:
            continue
        share = 100.0 * s.iqr_outliers / s.rows
        if share > 10:
            df = clip(df, column, *s.fences)
            actions.append((column, "capped", int(s.iqr_outliers)))
        elif 0 < share <= 5:
            df = df.where(number(df, column).between(*s.fences))
            actions.append((column, "removed", int(s.iqr_outliers)))
            if waiting:
                df = durable(df) if cut_lineage else df
                summaries = {s.column: s for s in summarize_numeric(df, waiting)}
    return df, actions
