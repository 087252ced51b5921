"""Scalar expressions with the semantics the operators agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.functions import constants as K

_SPACE_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in K.WHITESPACE) + "]"


def ref(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null."""
    kind = df.schema[name].dataType
    value = ref(name).cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(value, F.lit(None).cast("double"))
    return value


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has one."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return ref(name).isNull() | F.isnan(ref(name))
    return ref(name).isNull()


def is_blank_or_missing(df: DataFrame, name: str) -> Column:
    """Missing, or text that is empty, only whitespace, or the word ``nan``."""
    if isinstance(df.schema[name].dataType, T.StringType):
        stripped = strip(ref(name))
        return ref(name).isNull() | stripped.isin("", "nan")
    return is_missing(df, name)


def strip(value: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(value, F.lit(K.WHITESPACE))


def title(value: Column) -> Column:
    """Capitalise each run of letters, lower the rest: ``o'neil`` -> ``O'Neil``."""
    runs = F.split(value, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(
            runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        ),
        "",
    )


def words(value: Column) -> Column:
    """Whitespace-separated words as an array."""
    return F.filter(F.split(value, _SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def matches(value: Column, pattern: str) -> Column:
    """All non-overlapping matches of a pattern."""
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


def contains_any(value: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(value, F.lit(part))
    return hit


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def at_most(value: Column, limit: float) -> Column:
    return F.least(value, F.lit(float(limit)))


def severity(value: Column, high: float | None, medium: float | None) -> Column:
    """The three-step ladder with strict limits; a step may be absent."""
    step = F.lit("low")
    if medium is not None:
        step = F.when(value > medium, "medium").otherwise(step)
    if high is not None:
        step = F.when(value > high, "high").otherwise(step)
    return step


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
