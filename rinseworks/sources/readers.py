"""Readers for the file kinds the cleaning plans accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable, durable_text
from rinseworks.functions import constants as K
from rinseworks.functions.expr import ref, strip
from rinseworks.sources.splits import (
    BROKEN, LineRecords, ObjectRecords, brace_step, quote_step, read_pieces, records, split_effects, split_starts,
)

_OVERFLOW = "__overflow"
_CORRUPT = "__corrupt"
#: Splits whose first states are broadcast; beyond it a file is read by one task.
BROADCAST_SPLITS = 500_000


def csv_header(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", multi_line: bool = False
) -> list[str]:
    """Column names of a delimited file, made unique the way ``name``, ``name.1`` are."""
    frame = spark.read.csv(
        path, header=True, sep=delimiter, encoding=encoding, inferSchema=False, quote='"', escape='"', multiLine=multi_line
    )
    return frame.columns


def read_csv_permissive(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    delimiter: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """Delimited text whose lines may have too many or too few fields.

    Lines with too many fields are skipped, short ones padded with nulls, and the usual
    tokens for a missing value become null. A quote inside quotes is written twice; inside a
    field that does not begin with one it is data. Quoted fields may hold line ends, and
    files are read in splits all the same. Without a schema, columns in which every
    value is a number become bigint or double, which costs one scan. Files that are not
    valid in the given encoding are read as Latin-1. The scan that finds this out also finds
    the state in which each split begins.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if 'a"\n'.encode(encoding) == b'a"\n':
        lines = read_pieces(spark, path, "\n")
        effects = durable(split_effects(lines, quote_step(delimiter), '"'))
        if encoding.upper() == "UTF-8" and not effects.where("not valid").isEmpty():
            encoding = "ISO-8859-1"
        starts = durable(split_starts(effects))
        spans = not starts.where("sum > 0").isEmpty()
        cut = spans and starts.count() <= BROADCAST_SPLITS
        whole = spans and not cut
    else:  # not made of ASCII's bytes
        cut, whole = False, True
    names = schema.names if schema else csv_header(spark, path, delimiter, encoding, cut or whole)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _OVERFLOW]])
    if cut:
        rows = records(lines, starts, lambda inside, *_: LineRecords(delimiter, inside), b"\n")
        rows = rows.where("not (block = 0 and seq = 0)")  # each file's header
        text = F.rtrim(F.decode("value", encoding), F.lit("\r"))
        kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in texts.names)
        fields = F.from_csv(text, kinds, {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        raw = rows.select(fields.alias("r")).select("r.*")
    else:
        raw = spark.read.csv(
            path, schema=texts, header=True, sep=delimiter, encoding=encoding, mode="PERMISSIVE",
            enforceSchema=True, multiLine=whole, quote='"', escape='"',
        )
    kept = raw.where(ref(_OVERFLOW).isNull()).drop(_OVERFLOW)
    known = kept.select(
        *[F.when(~ref(n).isin(K.NA_TOKENS), ref(n)).alias(n) for n in names]
    )
    kinds = {f.name: f.dataType.simpleString() for f in schema} if schema else _infer(known)
    return known.select(
        *[
            ref(n) if kinds[n] == "string" else strip(ref(n)).try_cast(kinds[n]).alias(n)
            for n in names
        ]
    )


def _infer(df: DataFrame) -> dict[str, str]:
    """Column kinds from one scan; a whole column of integers with gaps is still double."""
    whole = r"^\s*[-+]?\d{1,18}\s*$"
    row = df.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(ref(c).rlike(whole)).alias(f"w{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(ref(c).rlike(K.NUMERIC_LITERAL)).alias(f"d{i}") for i, c in enumerate(df.columns)],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    kinds = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0 or row[f"d{i}"] < n:
            kinds[c] = "string"
        elif row[f"w{i}"] == n and n == row["rows"]:
            kinds[c] = "bigint"
        else:
            kinds[c] = "double"
    return kinds


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects as rows: one for each line, an array of objects, or one object as one row.

    All are read in splits. Objects that are no lines of their own are cut out at the brackets
    outside strings and written as lines first, a split by itself. Which of them the input is
    shows in its first line. Anything else, broken input included, is an error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not _one_object_a_line(spark, path):
        path = _objects_as_lines(spark, path)
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    if schema is None:
        schema = T.StructType([f for f in reader.json(path).schema if f.name != _CORRUPT])
    if not schema.fields:
        raise ValueError("expected JSON objects")
    frame = reader.schema(T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])).json(path)
    if frame.where(ref(_CORRUPT).isNotNull()).take(1):
        raise ValueError("expected JSON objects, an array of them or a single one")
    return frame.drop(_CORRUPT)


def _objects_as_lines(spark: SparkSession, path: str) -> str:
    pieces = read_pieces(spark, path, "}")
    starts = durable(split_starts(split_effects(pieces, brace_step)))
    files = starts.groupBy("file").agg(
        F.max_by(F.col("total") + F.col("sum"), "block").alias("depth"), F.max_by("end", "block").alias("open"),
        F.max("first").alias("first"), (F.max("size") - F.sum("bytes")).isin(0, 3).alias("closed"),  # 3: a byte order mark
    )
    # The last piece counts a brace that is not there, unless a brace is the file's last byte.
    well = F.when(F.col("closed"), (F.col("depth") == 0) & (F.col("first") == "{")).otherwise(F.col("depth") == -1)
    if not files.where(~well | F.col("open") | ~F.col("first").isin("{", "[")).isEmpty():
        raise ValueError("expected JSON objects, an array of them or a single one")
    if starts.count() > BROADCAST_SPLITS:
        raise ValueError(f"more than {BROADCAST_SPLITS} splits: write the objects as lines, or read fewer files at once")
    cut = durable(records(pieces, starts, ObjectRecords, b""))
    if not cut.where(F.col("part") == BROKEN).isEmpty():
        raise ValueError("expected JSON objects, an array of them or a single one")
    # A line end inside a string would be written as \\n, so those left are blanks.
    return durable_text(cut.select(F.translate(F.decode("value", "UTF-8"), "\r\n", "  ").alias("value")))


def _one_object_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is an object by itself."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).select(
        F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    ).first()
    return bool(first and first[0])


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line, stripped, in the column ``text``."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``(source, text)``, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read by kind: csv, json, text or parquet."""
    readers = {
        "csv": read_csv_permissive,
        "json": read_json,
        "text": read_text_lines,
        "parquet": lambda s, p: s.read.parquet(p),
    }
    if kind not in readers:
        raise ValueError(f"cannot read files of kind {kind!r}")
    return readers[kind](spark, path)
