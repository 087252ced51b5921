"""Choosing a repair by how well a small forest learns from the repaired table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable, small_frame, together
from rinseworks.functions.expr import is_missing, number, numeric_columns
from rinseworks.operators import repair
from rinseworks.operators.duplicates import drop_duplicates
from rinseworks.operators.impute import impute_mean, impute_median, impute_mode
from rinseworks.operators.quantiles import exact_quantiles
from rinseworks.plans.strategies import candidates, choose
from rinseworks.types import Issue, Strategy

# Candidates that are judged on the same table.
_SAME = {"knn_imputation": "mean_imputation"}


def _trial(df: DataFrame, issue: Issue, strategy: Strategy) -> DataFrame:
    """The table as a candidate is judged on.

    Differs from the real repair where the contract says so: dropping rows looks at all
    columns, neighbours see one column and so reduce to its mean, the logarithm needs
    positive values, and the remaining candidates leave the table as it is.
    """
    column = issue.column
    is_number = column in numeric_columns(df)
    match strategy.name:
        case "drop_rows":
            complete = F.lit(True)
            for c in df.columns:
                complete = complete & ~is_missing(df, c)
            return df.where(complete)
        case "mean_imputation":
            return impute_mean(df, column)
        case "knn_imputation" if is_number:
            return impute_mean(df, column)
        case "median_imputation":
            return impute_median(df, column)
        case "mode_imputation":
            return impute_mode(df, column)
        case "drop_duplicates":
            return drop_duplicates(df)
        case "remove_outliers" if is_number:
            return repair.remove_outliers_iqr(df, column)
        case "cap_outliers" if is_number:
            return repair.cap_outliers_percentile(
                df, column, strategy.parameters["lower"], strategy.parameters["upper"]
            )
        case "transform_outliers" if is_number:
            least = df.agg(F.min(number(df, column)), F.count(number(df, column)), F.count(F.lit(1)))
            low, present, rows = least.first()
            return repair.log_transform(df, column) if present == rows and low > 0 else df
        case _:
            return df


def evaluate(df: DataFrame, target: str, features: list[str], task: str, seed: int = 42) -> float:
    """Mean cross-validated quality of a 10-tree forest of depth 3, higher is better."""
    values = [number(df, c).alias(f"x{i}") for i, c in enumerate(features)]
    table = durable(df.select(number(df, target).alias("y"), *values).na.drop())
    rows = table.count()
    if rows < 10:
        return 0.0
    folds = min(3, rows // 5)
    assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="x")
    options = {"featuresCol": "x", "numTrees": 10, "maxDepth": 3, "seed": seed}
    if task == "classification":
        middle = exact_quantiles(table, ["y"], [0.5])["y"][0]
        table = table.withColumn("label", (F.col("y") > middle).cast("double"))
        learner = RandomForestClassifier(labelCol="label", **options)
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    else:
        learner = RandomForestRegressor(labelCol="y", **options)
        judge = RegressionEvaluator(labelCol="y", metricName="mse")
    cv = CrossValidator(
        estimator=Pipeline(stages=[assembler, learner]),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=judge,
        numFolds=folds,
        seed=seed,
    )
    quality = cv.fit(table).avgMetrics[0]
    return quality if task == "classification" else 1.0 / (1.0 + quality)


def select_by_model(df: DataFrame, issue: Issue, task: str) -> tuple[Strategy, DataFrame]:
    """The first best candidate and a frame ``(strategy, score, chosen)`` of all of them.

    Small tables and tables without a second numeric column fall back to the policy.
    """
    found = candidates(issue.issue_type, task)
    numbers = numeric_columns(df)
    rows = df.count()
    scores: list[tuple[Strategy, float | None]] = [(s, None) for s in found]
    if len(found) < 2 or rows < 100 or len(numbers) < 2:
        best = choose(issue, found, rows, issue.column in numbers)
    else:
        target = numbers[-1]
        trials = {s.name: _trial(df, issue, s) for s in found}
        kind = {n: "unchanged" if t is df else _SAME.get(n, n) for n, t in trials.items()}
        distinct = {kind[n]: t for n, t in trials.items()}
        quality = together(
            df.sparkSession,
            *[
                lambda t=t: evaluate(t, target, numbers[:-1], task)
                for t in distinct.values()
            ]
        )
        known = dict(zip(distinct, quality))
        scores = [(s, known[kind[s.name]]) for s in found]
        best = max(scores, key=lambda item: item[1])[0]
    table = small_frame(
        df.sparkSession,
        [(s.name, v, s.name == best.name) for s, v in scores],
        "strategy string, score double, chosen boolean",
    )
    return best, table
