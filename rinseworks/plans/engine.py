"""Detect everything on the input, then choose and apply one repair per issue."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from rinseworks.frames import durable, small_frame, together
from rinseworks.functions.expr import numeric_columns
from rinseworks.operators.consistency import detect_inconsistencies
from rinseworks.operators.duplicates import detect_column_duplicates, detect_exact_duplicates
from rinseworks.operators.missing import (
    detect_empty_columns,
    detect_missing,
    detect_mostly_empty_rows,
)
from rinseworks.operators.outliers import detect_numeric_outliers
from rinseworks.operators.profile import dataset_stats, iqr_outlier_counts
from rinseworks.plans.model_choice import select_by_model
from rinseworks.plans.strategies import (
    apply_strategy,
    candidates,
    choose,
    registered_detectors,
    rows_affected,
)
from rinseworks.types import ISSUE_FIELDS, ISSUE_SCHEMA, Action, CleaningReport, Issue

# Repairs stacked on one plan before it is written out and read back.
REPAIRS_PER_STEP = 4


def detect_issues(df: DataFrame) -> DataFrame:
    """Issues of all detectors, in the order the repairs are applied."""
    by_column = [
        detect_missing,
        detect_empty_columns,
        detect_mostly_empty_rows,
        detect_exact_duplicates,
        detect_column_duplicates,
        detect_numeric_outliers,
    ]
    as_found = [detect_inconsistencies, *registered_detectors().values()]
    found = together(  # a few rows per column each
        df.sparkSession,
        *[
            lambda d=detect: [tuple(r) for r in d(df).select(*ISSUE_FIELDS).collect()]
            for detect in [*by_column, *as_found]
        ]
    )
    place = {c: i for i, c in enumerate(df.columns)}
    issues: list[tuple] = []
    for i, rows in enumerate(found):
        if i < len(by_column):
            rows = sorted(rows, key=lambda r: place.get(r[1], -1))
        issues += rows
    return small_frame(
        df.sparkSession,
        issues,
        ISSUE_SCHEMA,
    )


def engine_clean(
    df: DataFrame, target_task: str | None = None, key: str | None = None
) -> tuple[DataFrame, CleaningReport]:
    """The repaired frame and the report of issues and actions.

    All issues come from the input; every repair recomputes its bounds on the frame the
    earlier repairs left. ``key`` names a row id, which neighbour imputation needs.
    """
    started = time.time()
    before = dataset_stats(df).first().asDict()
    issues = [Issue(*r) for r in detect_issues(df).collect()]
    actions = []
    rows = before["total_rows"]
    stacked = 0
    for issue in issues:
        found = candidates(issue.issue_type, target_task)
        if target_task and len(found) > 1:
            strategy, _ = select_by_model(df, issue, target_task)
        else:
            is_number = issue.column in numeric_columns(df)
            strategy = choose(issue, found, rows, is_number)
        try:
            after = apply_strategy(df, issue, strategy, key)
            written = strategy.name in ("drop_duplicates", "remove_outliers")
            if after is not df and written:  # counting reads the rows again
                after = durable(after)
            changed = rows_affected(df, issue, strategy, after) if after is not df else 0
        except (PySparkException, ValueError) as error:  # the run goes on with the next issue
            actions.append(Action(issue, strategy, success=False, error=str(error)))
            continue
        actions.append(Action(issue, strategy, changed))
        if after is not df:
            stacked += 1
            df = after
            if strategy.name in ("drop_rows", "drop_duplicates", "remove_outliers"):
                rows -= changed
            if stacked % REPAIRS_PER_STEP == 0 and not written:
                df = durable(df)
    after_stats = dataset_stats(df).first().asDict()
    return df, CleaningReport(issues, actions, before, after_stats, time.time() - started)


def actions_frame(spark, report: CleaningReport) -> DataFrame:
    """One row per action: issue, strategy and the rows it changed."""
    rows = [
        (i, a.issue.issue_type, a.issue.column, a.strategy.name, int(a.rows_affected), a.success)
        for i, a in enumerate(report.actions)
    ]
    return small_frame(
        spark,
        rows,
        "step bigint, issue_type string, column string, strategy string, rows_affected bigint, "
        "success boolean",
    )


def report_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells, duplicates and outliers that a repair took away."""
    def measure(frame):
        stats, outliers = together(
            frame.sparkSession,
            lambda: dataset_stats(frame).first(),
            lambda: iqr_outlier_counts(frame).collect(),
        )
        return stats["missing_values"], stats["duplicates"], sum(r["outliers"] for r in outliers)

    b, a = together(before.sparkSession, lambda: measure(before), lambda: measure(after))
    return small_frame(
        before.sparkSession,
        [(b[0] - a[0], b[1] - a[1], b[2] - a[2])],
        "missing_values_fixed bigint, duplicates_removed bigint, outliers_handled bigint",
    )
