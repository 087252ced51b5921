"""Which repair fits which issue: the policy, the choice and the hand-made extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.functions.expr import is_missing, number, numeric_columns, ref
from rinseworks.operators.impute import (
    impute_context_mode,
    impute_iterative,
    impute_knn,
    impute_mean,
    impute_median,
    impute_mode,
)
from rinseworks.operators.quantiles import exact_quantiles
from rinseworks.operators.spelling import basic_dictionary, correct_spelling
from rinseworks.operators import repair
from rinseworks.operators.duplicates import drop_duplicates
from rinseworks.types import Issue, Strategy

# --- fixed values: candidates per issue type in order of preference ----------
POLICY: dict[str, list[Strategy]] = {
    "missing_values": [
        Strategy("drop_rows", "drop rows without a value", {"threshold": 0.5}),
        Strategy("mean_imputation", "fill with the mean", {"strategy": "mean"}),
        Strategy("median_imputation", "fill with the median", {"strategy": "median"}),
        Strategy("mode_imputation", "fill with the mode", {"strategy": "mode"}),
        Strategy(
            "categorical_context_imputation",
            "fill with the mode of rows with equal parents",
            {"max_parents": 2, "max_categories": 30},
        ),
        Strategy("knn_imputation", "fill from the nearest rows", {"n_neighbors": 5}),
        Strategy("iterative_imputation", "fill by regression", {"max_iter": 10}),
    ],
    "exact_duplicates": [
        Strategy("drop_duplicates", "keep one of equal rows", {"keep": "first"}),
        Strategy("keep_duplicates", "leave equal rows"),
    ],
    "numeric_outliers": [
        Strategy("remove_outliers", "drop rows outside the fences", {"method": "iqr"}),
        Strategy(
            "cap_outliers",
            "clip to percentiles",
            {"method": "percentile", "lower": 0.05, "upper": 0.95},
        ),
        Strategy("transform_outliers", "take logarithms", {"method": "log"}),
        Strategy("keep_outliers", "leave outliers"),
    ],
    "inconsistent_case": [
        Strategy("lowercase", "lower-case the text"),
        Strategy("uppercase", "upper-case the text"),
        Strategy("title_case", "capitalise words"),
    ],
    "leading_trailing_whitespace": [Strategy("strip_whitespace", "strip the text")],
    "spelling_errors": [Strategy("correct_spelling", "replace misspelt words", {"columns": None, "dictionary": None})],
}
NO_ACTION = Strategy("no_action", "leave the data as it is")

Detector = Callable[[DataFrame], DataFrame]
Repair = Callable[[DataFrame, Issue, dict], DataFrame]
_detectors: dict[str, Detector] = {}
_repairs: dict[tuple[str, str], Repair] = {}
_extra: dict[str, list[Strategy]] = {}


def register_detector(name: str, detect: Detector) -> None:
    """Add a function from a frame to an issues frame; it runs after the built-in ones."""
    _detectors[name] = detect


def register_strategy(
    issue_type: str, name: str, apply: Repair, description: str = "", **parameters
) -> None:
    """Add a candidate for an issue type; ``apply(df, issue, parameters)`` returns a frame."""
    _repairs[(issue_type, name)] = apply
    known = [s for s in _extra.get(issue_type, []) if s.name != name]
    _extra[issue_type] = [*known, Strategy(name, description, parameters)]


def unregister(name: str) -> None:
    """Remove a registered detector or strategy again."""
    _detectors.pop(name, None)
    for kind, other in [k for k in _repairs if k[1] == name]:
        del _repairs[(kind, other)]
        _extra[kind] = [s for s in _extra[kind] if s.name != name]


def registered_detectors() -> dict[str, Detector]:
    return dict(_detectors)


def candidates(issue_type: str, target_task: str | None = None) -> list[Strategy]:
    """Strategies for an issue type; classification avoids those that remove data by name."""
    found = POLICY.get(issue_type, []) + _extra.get(issue_type, [])
    if target_task == "classification":
        found = [s for s in found if "remove" not in s.name.lower()]
    return found


def _first(found: list[Strategy], part: str) -> Strategy:
    return next((s for s in found if part in s.name), found[0])


def choose(issue: Issue, found: list[Strategy], rows: int, is_number: bool) -> Strategy:
    """The choice without a model."""
    if not found:
        return NO_ACTION
    if len(found) == 1:
        return found[0]
    if issue.issue_type == "missing_values":
        if rows and 100.0 * issue.affected_rows / rows > 70:
            return _first(found, "drop")
        if is_number:
            return _first(found, "median")
        context = [s for s in found if s.name == "categorical_context_imputation"]
        return context[0] if context else _first(found, "mode")
    wanted = {"exact_duplicates": "drop", "numeric_outliers": "cap"}.get(issue.issue_type)
    return _first(found, wanted) if wanted else found[0]


def select_strategy(issues: DataFrame, df: DataFrame, target_task: str | None = None) -> DataFrame:
    """The issues widened by the chosen strategy, as one expression over the issues.

    The policy decides per issue type, share of missing rows and kind of column.
    """
    mostly = 100.0 * F.col("affected_rows") / F.lit(max(df.count(), 1)) > 70
    is_number = F.col("column").isin(numeric_columns(df))
    chosen = F.lit(NO_ACTION.name)
    for kind in {**POLICY, **_extra}:
        found = candidates(kind, target_task)

        def pick(share: int, number: bool, kind=kind, found=found):
            issue = Issue(kind, "", share, float(share), "", "")
            return F.lit(choose(issue, found, 100, number).name)

        value = F.when(mostly, pick(100, False)).when(is_number, pick(0, True))
        chosen = F.when(F.col("issue_type") == kind, value.otherwise(pick(0, False))).otherwise(chosen)
    return issues.withColumn("strategy", chosen)


def apply_strategy(df: DataFrame, issue: Issue, strategy: Strategy, key: str | None = None) -> DataFrame:
    """The repaired frame; names that keep the data, and unknown ones, change nothing.

    Raises ValueError where a repair lacks what it needs.
    """
    own = _repairs.get((issue.issue_type, strategy.name))
    if own is not None:
        return own(df, issue, strategy.parameters)
    column, given = issue.column, strategy.parameters
    is_number = column in numeric_columns(df)
    match strategy.name:
        case "drop_rows":
            if column:
                return repair.drop_missing_rows(df, column)
            return repair.drop_sparse_rows(df, given.get("threshold", 0.5))
        case "mean_imputation":
            return impute_mean(df, column)
        case "median_imputation":
            return impute_median(df, column)
        case "mode_imputation":
            return impute_mode(df, column)
        case "categorical_context_imputation":
            return impute_context_mode(
                df, column, given.get("max_parents", 2), given.get("max_categories", 30)
            )
        case "knn_imputation" if is_number and not key:
            raise ValueError("knn_imputation needs the name of a row id")
        case "knn_imputation" if is_number:
            return impute_knn(df, key, given.get("n_neighbors", 5))
        case "iterative_imputation" if is_number:
            return impute_iterative(df, given.get("max_iter", 10))
        case "drop_duplicates":
            return drop_duplicates(df, given.get("keep", "first"))
        case "remove_outliers" if is_number:
            return repair.remove_outliers_iqr(df, column)
        case "cap_outliers" if is_number:
            return repair.cap_outliers_percentile(
                df, column, given.get("lower", 0.05), given.get("upper", 0.95)
            )
        case "transform_outliers" if is_number:
            return repair.log_transform(df, column)
        case "lowercase" | "uppercase" | "title_case" if column:
            return repair.convert_case(df, column, strategy.name)
        case "strip_whitespace" if column:
            return repair.strip_whitespace(df, column)
        case "correct_spelling" if not key:
            raise ValueError("correct_spelling needs the name of a row id")
        case "correct_spelling":
            words = given.get("dictionary")
            words = basic_dictionary(df.sparkSession) if words is None else words
            return correct_spelling(df, key, given.get("columns") or [column], words)
        case _:
            return df


def rows_affected(df: DataFrame, issue: Issue, strategy: Strategy, after: DataFrame) -> int:
    """Rows a repair changes or drops, counted on its input where that is possible."""
    column = issue.column
    match strategy.name:
        case "drop_rows" if column:
            test = is_missing(df, column)
        case name if name.endswith("imputation"):
            test = is_missing(df, column)
            if name == "categorical_context_imputation":
                test = test | (repair.strip(ref(column)) == "")
        case "lowercase" | "uppercase" | "title_case":
            test = ~repair.cased(ref(column), strategy.name).eqNullSafe(ref(column))
        case "strip_whitespace":
            test = ~repair.strip(ref(column)).eqNullSafe(ref(column))
        case "transform_outliers" if column in numeric_columns(df):
            test = number(df, column).isNotNull()
        case "cap_outliers" if column in numeric_columns(df):
            low, high = exact_quantiles(
                df, [column],
                [strategy.parameters.get("lower", 0.05), strategy.parameters.get("upper", 0.95)],
            )[column] or (None, None)
            test = (number(df, column) < F.lit(low)) | (number(df, column) > F.lit(high))
        case "remove_outliers" | "drop_duplicates" | "drop_rows":
            return df.count() - after.count()
        case "correct_spelling":
            return df.exceptAll(after).count()
        case _:
            return 0
    return df.agg(F.count_if(test)).first()[0]
