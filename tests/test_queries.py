"""Registered queries against their SQL at the smallest scale; an empty result fails.

``SKIP_SLOW=1`` leaves out the slowest ones.
"""

import os

import pytest
from compare import compare, database

from workload import registry

FOLDER = "/root/testdata/sf0.001"
SLOW = {
    "auto_clean", "cluster_similar", "correct_spelling", "data_preview", "detect_issues",
    "engine_actions", "engine_clean", "impute_iterative", "infer_column_roles", "issue_labels",
    "isolation_forest_flags", "profile_summary", "quality_analysis", "quality_comparison",
    "quality_score_lineitem", "recommendations", "report_metrics", "select_by_model",
    "select_strategy", "severity_breakdown", "word_boxes_to_table", "sniff_delimited", "role_shares",
}
NAMES = [n for n in registry.QUERIES if not (os.environ.get("SKIP_SLOW") and n in SLOW)]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name, registry.QUERIES[name], registry.SQL.get(name))
    assert problem is None, problem


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "quality_score"
