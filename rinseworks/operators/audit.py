"""Redaction, structured events, audit roll-ups and the metadata look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.functions import constants as K
from rinseworks.functions.expr import ref


def redact(value: Column) -> Column:
    """Sensitive text replaced, pattern after pattern."""
    for pattern in K.SENSITIVE.values():
        value = F.regexp_replace(value, "(?i)" + pattern, K.REDACTED)
    return value


def redact_sensitive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: redact(ref(c)) for c in columns})


def sensitive_counts(df: DataFrame, column: str) -> DataFrame:
    """``(pattern, matches, rows)``: how often each pattern occurs in the text as given."""
    hits = [F.regexp_count(ref(column), F.lit("(?i)" + p)) for p in K.SENSITIVE.values()]
    rows = [
        F.struct(
            F.lit(name).alias("pattern"),
            F.coalesce(F.sum(h), F.lit(0)).cast("bigint").alias("matches"),
            F.count_if(h > 0).alias("rows"),
        )
        for name, h in zip(K.SENSITIVE, hits)
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def structured_events(df: DataFrame, **fields: Column) -> DataFrame:
    """One JSON line per row from the named fields; null fields are left out."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("entry"))


def audit_trail(df: DataFrame, action: Column, resource: Column, user: Column, details: Column) -> DataFrame:
    """Audit rows ``(action, resource, user_id, details, message)``; details is a struct."""
    return df.select(
        action.alias("action"),
        resource.alias("resource"),
        user.alias("user_id"),
        F.to_json(details).alias("details"),
        F.concat(F.lit("AUDIT: "), action, F.lit(" on "), resource).alias("message"),
    )


def audit_rollup(df: DataFrame, action: str, user: str, when: str) -> DataFrame:
    """Events per action and user with the first and last time."""
    return df.groupBy(ref(action).alias("action"), ref(user).alias("user_id")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(ref(when)).alias("first_seen"),
        F.max(ref(when)).alias("last_seen"),
    )


def recent(df: DataFrame, when: str, key: str, limit: int = 50) -> DataFrame:
    """The newest rows, ties by key; a top-k that keeps k rows per task."""
    return df.orderBy(ref(when).desc(), ref(key)).limit(limit)


def lookup_by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with the key; the filter reaches the files."""
    return df.where(ref(key) == F.lit(value))


def data_preview(df: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The first rows by key as text, nulls empty. Deviation: ordered by key."""
    first = df.orderBy(ref(key)).limit(limit)
    return first.select(
        *[F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
