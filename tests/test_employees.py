"""A small table of boats with results worked out by hand."""

import pytest

from rinseworks.operators import missing, outliers, profile, quality
from rinseworks.plans import auto, engine
from rinseworks.sources import readers

BOATS = """boat,length,price,harbour
Heron,6,1200,North
Tern,8,,North
Plover,7,900,South
Gull,9,1500,East
Heron,6,1200,North
Dunlin,5,800,South
Knot,8,NULL,East
Avocet,7,30000,South
"""


@pytest.fixture(scope="module")
def boats(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("boats") / "boats.csv"
    path.write_text(BOATS)
    return readers.read_csv_permissive(spark, str(path))


def test_types_and_counts(boats):
    assert dict(boats.dtypes) == {"boat": "string", "length": "bigint", "price": "double", "harbour": "string"}
    row = profile.dataset_stats(boats).first()
    assert (row.total_rows, row.total_columns, row.missing_values, row.duplicates) == (8, 4, 2, 1)


def test_quartiles_and_outliers(boats):
    found = {s.column: s for s in profile.summarize_numeric(boats)}
    # Prices 800 900 1200 1200 1500 30000: places 1.25 and 3.75; lengths 5 6 6 7 7 8 8 9: places 1.75 and 5.25.
    assert (found["price"].q1, found["price"].q3, found["price"].iqr_outliers) == (975, 1425, 1)
    assert (found["length"].q1, found["length"].q3, found["length"].iqr_outliers) == (6, 8, 0)


def test_detectors(boats):
    assert {r.column: r.percentage for r in missing.detect_missing(boats).collect()} == {"price": 25.0}
    assert [r.boat for r in outliers.iqr_flags(boats, "price").collect()] == ["Avocet"]
    # Of six values none can be three deviations from the mean, and an issue needs both rules.
    assert outliers.detect_numeric_outliers(boats).isEmpty()


def test_score(boats):
    issues = quality.analyze_quality(boats)
    # 2 of 8 prices miss: 25 %, as many points. 1 of 8 rows repeats: 12.5 %, over the 10 points at most.
    # 1 of 6 prices lies outside: 16.7 %, over the 5 points at most.
    assert {(r.issue_type, r.column): (r.severity, r.deduction) for r in issues.collect()} == {
        ("missing_values", "price"): ("medium", 25.0),
        ("duplicates", "all_columns"): ("high", 10.0),
        ("outliers", "price"): ("medium", 5.0),
    }
    row = quality.score(issues).first()
    assert (row.quality_score, row.total_issues) == (60.0, 3)
    assert (row.high_severity, row.medium_severity, row.low_severity) == (1, 2, 0)


def test_auto_clean(boats):
    out, steps = auto.auto_clean(boats)
    rows = {r.boat: r for r in out.collect()}
    assert len(rows) == out.count() == 7  # one Heron of two
    # The middle of 800 900 1200 1200 1500 30000.
    assert rows["Tern"].price == rows["Knot"].price == 1200
    assert rows["Gull"].price == 1500 and rows["Dunlin"].length == 5
    done = {(r.step, r.column): r.rows for r in steps.collect()}
    assert done[("duplicates", None)] == 1 and done[("missing values", "price")] == 2


def test_engine_clean(boats):
    out, report = engine.engine_clean(boats)
    kinds = [(a.issue.issue_type, a.issue.column, a.strategy.name, a.rows_affected) for a in report.actions]
    assert kinds == [
        ("missing_values", "price", "median_imputation", 2),
        ("exact_duplicates", None, "drop_duplicates", 1),
        ("column_duplicates", "boat", "no_action", 0),
        ("column_duplicates", "length", "no_action", 0),
        ("column_duplicates", "harbour", "no_action", 0),
    ]
    assert (report.before["missing_values"], report.before["duplicates"], report.before["total_rows"]) == (2, 1, 8)
    assert (report.after["missing_values"], report.after["duplicates"], report.after["total_rows"]) == (0, 0, 7)
    assert sorted(r.price for r in out.collect()) == [800, 900, 1200, 1200, 1200, 1500, 30000]
