"""Text documents that are really delimited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.functions import constants as K
from rinseworks.functions.expr import let, ref, strip


def _fields(line: Column, delimiter: str) -> Column:
    """The fields of a line; delimiters inside double quotes do not count, and a doubled
    quote inside them is one quote."""
    literal = "\\Q" + delimiter + "\\E"
    outside = literal + "(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
    quoted = F.transform(
        F.split(line, outside),
        lambda p: F.when(
            p.rlike('^".*"$') & (F.length(p) > 1),
            F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(p),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, literal))


def _attempt(lines: Column, delimiter: str) -> Column:
    """Header and records under a delimiter; null when it yields a single column."""
    body = F.when(F.size(lines) > 1, F.slice(lines, F.lit(2), F.size(lines) - 1)).otherwise(
        F.array().cast("array<string>")
    )

    def parsed(header):
        records = F.filter(
            F.transform(body, lambda line: _fields(line, delimiter)),
            lambda r: (F.size(r) <= F.size(header))
            & F.exists(r, lambda v: ~strip(v).isin(K.NA_TOKENS)),
        )
        return F.when(
            F.size(header) > 1,
            F.struct(
                F.lit(delimiter).alias("delimiter"),
                header.alias("header"),
                records.alias("records"),
            ),
        )

    first = F.get(lines, F.lit(0))
    return F.when(F.contains(first, F.lit(delimiter)), let(_fields(first, delimiter), parsed))


def sniff_delimited(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, delimiter, columns, rows, header, records)`` of texts that parse as tables.

    Tab, comma, bar and semicolon are tried in this order; the first that yields more
    than one column and a row with content wins. Blank lines are skipped, lines with too
    many fields are left out, short ones padded with nulls.
    """
    lines = F.filter(F.split(ref(text), "\r\n|\n|\r"), lambda s: strip(s) != "")
    held = df.select(ref(key), lines.alias("__lines"))
    tries = [_attempt(F.col("__lines"), d) for d in K.DELIMITERS]
    best = let(
        F.array(*tries),
        lambda found: F.get(
            F.filter(found, lambda t: t.isNotNull() & (F.size(t["records"]) > 0)), F.lit(0)
        ),
    )
    return (
        held.select(ref(key), best.alias("t"))
        .where(F.col("t").isNotNull())
        .select(
            ref(key),
            "t.delimiter",
            F.size("t.header").cast("bigint").alias("columns"),
            F.size("t.records").cast("bigint").alias("rows"),
            "t.header",
            "t.records",
        )
    )


def delimited_rows(sniffed: DataFrame, key: str) -> DataFrame:
    """One row per record with its fields as a map from header; missing tokens are null."""
    at = F.posexplode("records").alias("at", "record")
    value = F.transform(
        F.sequence(F.lit(0), F.size("header") - 1),
        lambda i: F.when(~strip(F.get("record", i)).isin(K.NA_TOKENS), F.get("record", i)),
    )
    return sniffed.select(ref(key), "header", at).select(
        ref(key),
        F.col("at").cast("bigint").alias("row_id"),
        F.map_from_arrays("header", value).alias("data"),
    )
