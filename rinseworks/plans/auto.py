"""The fixed four-step repair: missing values, duplicates, outliers, text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rinseworks.frames import durable, small_frame
from rinseworks.functions.expr import numeric_columns
from rinseworks.operators.impute import fill, impute_parent_mode
from rinseworks.operators.profile import missing_counts
from rinseworks.operators.quantiles import exact_quantiles
from rinseworks.operators.repair import adaptive_outliers, normalize_text_columns


def auto_impute(df: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Drop columns over 70 percent missing; fill the rest column after column.

    Numbers take the median, other columns the mode under a parent. A filled column can
    be the parent of a later one, so their order matters; medians do not interact and
    come from one summary.
    """
    seen = {r["column"]: (r["total"], r["missing"]) for r in missing_counts(df).collect()}
    gaps = [c for c in df.columns if seen[c][1] > 0]
    numbers = set(numeric_columns(df))

    def sparse(c):
        return 100.0 * seen[c][1] / seen[c][0] > 70

    medians = exact_quantiles(
        df,
        [c for c in gaps if c in numbers and not sparse(c)],
        [0.5],
        {c: total - missing for c, (total, missing) in seen.items()},
    )
    actions = []
    for c in gaps:
        if sparse(c):
            df = df.drop(c)
            actions.append((c, "dropped column", seen[c][1]))
        elif c in numbers:
            df = fill(df, c, medians[c][0])
            actions.append((c, "median", seen[c][1]))
        else:
            df, parent = impute_parent_mode(df, c)
            how = f"group mode by {parent}" if parent else "mode"
            actions.append((c, how, seen[c][1]))
    return df, actions


def auto_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired frame and a frame ``(step, column, action, rows)`` of what was done.

    The deduplicated frame is written out once, since every later bound reads it.
    """
    before = df.count()
    df, imputed = auto_impute(df)
    df = durable(df.dropDuplicates())
    dropped = before - df.count()  # answered by the files' footers
    df, capped = adaptive_outliers(df)
    df = normalize_text_columns(df)
    rows = [("missing values", *a) for a in imputed]
    if dropped:
        rows.append(("duplicates", None, "dropped rows", dropped))
    rows += [("outliers", *a) for a in capped]
    steps = small_frame(
        df.sparkSession, rows, "step string, column string, action string, rows bigint"
    )
    return df, steps
