"""Registration of queries with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseworks.functions import constants as K
from workload.views import Data, sql_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COLUMNS = {
    "dirty_orders": (
        ["o_orderkey", "o_custkey", "o_totalprice", "sparse_num"],
        ["o_orderstatus", "o_orderpriority"],
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "sparse_num"],
    ),
    "gappy_orders": (
        ["o_orderkey", "o_custkey", "o_totalprice", "empty_num"],
        ["o_orderstatus", "o_orderpriority"],
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "empty_num"],
    ),
    "dirty_customer": (
        ["c_custkey", "c_nationkey", "c_acctbal"],
        ["c_mktsegment", "email", "phone", "balance_text", "date_text"],
        ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "email", "phone", "balance_text", "date_text"],
    ),
    "dirty_part": (
        ["p_partkey", "p_retailprice"],
        ["p_name", "p_brand", "p_container", "p_type"],
        ["p_partkey", "p_name", "p_brand", "p_container", "p_type", "p_retailprice"],
    ),
    "events": (["event_id", "user_id", "value"], ["event_type", "props"],
               ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"],
             ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source"],
                  ["doc_id", "text", "lang", "source", "n_chars"]),
    "misdecoded_documents": (["doc_id"], ["text", "code"], ["doc_id", "text", "code"]),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    ),
}


def query(sql: str | None = None):
    """Register the function under its name; it gets the data folder as :class:`Data`."""

    def add(run: Callable[[Data], DataFrame]):
        QUERIES[run.__name__] = lambda spark, folder: run(Data(spark, folder))
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def with_view(view: str, *more: str) -> str:
    """``with v as (<view or table>), ...``."""
    body = f"select * from {view}" if view in ("events", "part", "documents", "lineitem") else sql_view(view)
    return "with " + ", ".join([f"v as ({body})", *more]) + "\n"


def each(columns: list[str], text: str) -> str:
    """The text once per column, joined by union all; ``{c}`` is the column."""
    return "\nunion all ".join(text.replace("{c}", c) for c in columns)


def strip_sql(c: str) -> str:
    chars = "concat(" + ", ".join(f"chr({ord(x)})" for x in K.WHITESPACE) + ")"
    return f"trim({c}, {chars})"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def core(issues: DataFrame) -> DataFrame:
    """The comparable part of an issues frame."""
    return rounded(
        issues.select("issue_type", "column", "affected_rows", "percentage", "severity"), "percentage"
    )
