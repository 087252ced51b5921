"""Writers for cleaned data, profiles and reports; every output is a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rinseworks.operators.profile import column_profile, dataset_stats
from rinseworks.plans.engine import actions_frame
from rinseworks.types import CleaningReport, ISSUE_SCHEMA
from rinseworks.frames import small_frame


def write_cleaned(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write in the given format: csv with header, json records or parquet.

    In csv a quote inside quotes is written twice, and text with line ends is quoted.
    """
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(
            path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"cannot write files of kind {kind!r}")


def write_profile(df: DataFrame, path: str) -> None:
    """Table statistics and column profiles as JSON."""
    dataset_stats(df).write.mode("overwrite").json(f"{path}/table")
    column_profile(df).write.mode("overwrite").json(f"{path}/columns")


def write_report(spark, report: CleaningReport, path: str) -> None:
    """Issues and actions of a cleaning run as JSON."""
    issues = [
        (i.issue_type, i.column, i.affected_rows, i.percentage, i.severity, i.description)
        for i in report.issues
    ]
    small_frame(spark, issues, ISSUE_SCHEMA).write.mode("overwrite").json(f"{path}/issues")
    actions_frame(spark, report).write.mode("overwrite").json(f"{path}/actions")
