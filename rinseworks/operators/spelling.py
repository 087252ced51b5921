"""Spelling checks and corrections against a dictionary table."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable, small_frame
from rinseworks.functions import constants as K
from rinseworks.functions.expr import percent, ref, severity, text_columns
from rinseworks.operators.consistency import detect_encoding_issues
from rinseworks.operators.frequency import stacked_text
from rinseworks.types import ISSUE_SCHEMA

# Bits of the filter over corrections, and rows that a correction is copied to.
FILTER_BITS = 1 << 20
SALTS = 16
# Rows of a batch whose words are replaced at a time.
ROWS = 64

_WORD = re.compile(r"\w+")


def basic_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary used when the caller has none."""
    return small_frame(spark, [(w, 1) for w in K.BASIC_WORDS], "term string, freq bigint")


def dictionary_from_text(df: DataFrame, text: str) -> DataFrame:
    """``(term, freq)`` of the English-letter words in a trusted text column."""
    return word_counts(df, ref(text)).select(F.col("word").alias("term"), F.col("cnt").alias("freq"))


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """``(word, cnt)`` of lower-cased words made of the letters a to z alone.

    A run of letters next to an accented letter, digit or underscore is part of a
    longer word and does not count.
    """
    return _counts(df.select(text.alias("value")), "value").drop("column")


def _counts(df: DataFrame, text: str) -> DataFrame:
    """:func:`word_counts` for each value of ``column``, null if there is none."""
    column = F.col("column") if "column" in df.columns else F.lit(None).cast("string").alias("column")
    pieces = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+")
    return (
        df.select(column, F.explode(pieces).alias("word"))
        .where(F.col("word").rlike("^[a-z]+$"))
        .groupBy("column", "word")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def spelling_stats(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """One row: words, and words over two letters that the dictionary lacks.

    Words are counted before the join, so a frequent word travels once.
    """
    counts = word_counts(df, ref(column))
    known = dictionary.select(F.col("term").alias("word"), F.lit(True).alias("known")).dropDuplicates()
    wrong = F.col("known").isNull() & (F.length("word") > 2)
    return counts.join(known, "word", "left").agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(wrong, F.col("cnt"))), F.lit(0)).alias("spelling_errors"),
    )


def detect_spelling_errors(df: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    dictionary = basic_dictionary(df.sparkSession) if dictionary is None else dictionary
    row = spelling_stats(df, column, dictionary).first()
    errors, total = row["spelling_errors"], row["total_words"]
    rate = 100.0 * errors / total if total else 0.0
    rows = []
    if rate > 5:
        text = f"Column '{column}' has {errors} spelling errors ({rate:.1f}% error rate)"
        rows = [("spelling_errors", column, errors, rate, "medium" if rate > 10 else "low", text)]
    return small_frame(df.sparkSession, rows, ISSUE_SCHEMA)


def detect_text_anomalies(
    df: DataFrame, columns: list[str] | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """Spelling and encoding issues of the text columns, or of those named, in one frame.

    The words of all columns are counted together and meet the dictionary once. Columns that
    are no text columns of the frame are passed over.
    """
    texts = text_columns(df)
    columns = [c for c in texts if columns is None or c in columns]
    dictionary = basic_dictionary(df.sparkSession) if dictionary is None else dictionary
    known = dictionary.select(F.col("term").alias("word"), F.lit(True).alias("known")).dropDuplicates()
    wrong = F.col("known").isNull() & (F.length("word") > 2)
    stats = (
        _counts(stacked_text(df, columns), "value")
        .join(known, "word", "left")
        .groupBy("column")
        .agg(F.sum("cnt").alias("total"), F.coalesce(F.sum(F.when(wrong, F.col("cnt"))), F.lit(0)).alias("errors"))
        .withColumn("rate", percent(F.col("errors"), F.col("total")))
    )
    misspelt = stats.where(F.col("rate") > 5).select(
        F.lit("spelling_errors").alias("issue_type"),
        "column",
        F.col("errors").alias("affected_rows"),
        F.col("rate").alias("percentage"),
        severity(F.col("rate"), None, 10).alias("severity"),
        F.format_string(
            "Column '%s' has %d spelling errors (%.1f%% error rate)", F.col("column"), F.col("errors"), F.col("rate")
        ).alias("description"),
    )
    return misspelt.unionByName(detect_encoding_issues(df.select(*[ref(c) for c in columns])))


def _deletions(word: Column) -> Column:
    """The word and all its forms with one letter left out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def _swapped(word: Column, term: Column) -> Column:
    """Whether exchanging two neighbouring letters of the word gives the term."""
    return (F.length(word) == F.length(term)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))),
        lambda i: F.concat(
            F.substr(word, F.lit(1), i - 1),
            F.substr(word, i + 1, F.lit(1)),
            F.substr(word, i, F.lit(1)),
            F.substr(word, i + 2),
        )
        == term,
    )


def spelling_corrections(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``(word, correction)`` for unknown words one edit away from a dictionary term.

    An edit inserts, deletes, replaces or exchanges neighbouring letters. Two words one
    edit apart share a form with at most one letter left out, so the candidates come
    from an equi-join on those forms, and the edit itself is then verified. Ties go to
    the more frequent, then the smaller term.
    """
    terms = dictionary.groupBy("term").agg(F.sum("freq").alias("freq"))
    unknown = (
        word_counts(df, ref(column))
        .where(F.length("word") > 2)
        .select("word")
        .join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    )
    left = unknown.select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    right = terms.select("term", "freq", F.explode(_deletions(F.col("term"))).alias("form"))
    near = (F.levenshtein("word", "term") <= 1) | _swapped(F.col("word"), F.col("term"))
    return (
        left.join(right, "form")
        .where(near)
        .groupBy("word")
        .agg(F.min_by("term", F.struct((-F.col("freq")).alias("f"), F.col("term"))).alias("correction"))
    )


def correct_spelling(
    df: DataFrame, key: str, columns: str | list[str], dictionary: DataFrame
) -> DataFrame:
    """The frame with misspelt words of text columns replaced by their correction.

    Whole words only, lower case; ``key`` must be unique. Only distinct words of a row that
    pass a filter over the corrections are shuffled; a word that very many rows hold is
    spread by salt.
    """
    columns = [columns] if isinstance(columns, str) else columns
    texts = stacked_text(df, columns)
    fixes = durable(spelling_corrections(texts, "value", dictionary))
    salted = fixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = _words_to_fix(df, key, columns, fixes).join(salted, ["word", "salt"])
    fix = F.struct("word", "correction")
    per_row = found.groupBy("__key").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("at") == i, fix))).alias(f"__fix{i}") for i in range(len(columns))
    ])
    out = df.join(per_row, ref(key) == F.col("__key"), "left")
    for i, c in enumerate(columns):
        out = out.withColumn(
            c, F.when(F.coalesce(F.size(f"__fix{i}"), F.lit(0)) < 1, ref(c)).otherwise(_replace_words(ref(c), F.col(f"__fix{i}")))
        )
    return out.select(*[ref(c) for c in df.columns])


def _words_to_fix(df: DataFrame, key: str, columns: list[str], fixes: DataFrame) -> DataFrame:
    """``(__key, at, word, salt)``: the distinct words of each row and column that may have a correction.

    The filter is a bitmap of a fixed size over hashes of the words; it lets through every
    word with a correction and few others.
    """
    place = F.pmod(F.xxhash64("word"), F.lit(FILTER_BITS))
    bits = fixes.select((place / 64).cast("int").alias("at"), (place % 64).cast("int").alias("bit")).groupBy("at").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits")
    )
    words = [0] * (FILTER_BITS // 64)
    for r in bits.collect():  # at most as many rows as the bitmap has numbers
        words[r["at"]] = r["bits"]
    bitmap = F.from_json(F.lit(str(words)), "array<bigint>")
    used = df.select(
        ref(key).alias("__key"),
        F.posexplode(F.array(*[
            F.array_distinct(F.split(F.lower(ref(c)), r"[^\p{L}\p{N}_]+")) for c in columns
        ])).alias("at", "words"),
    ).select("__key", "at", F.explode("words").alias("word"))
    hit = F.expr("getbit(get(bitmap, int(place div 64)), int(place % 64)) = 1")
    return (
        used.where(F.length("word") > 2).withColumn("place", place).withColumn("bitmap", bitmap).where(hit)
        .select("__key", "at", "word", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int").alias("salt"))
    )


@F.arrow_udf(T.StringType())
def _replace_words(texts: pa.Array, fixes: pa.Array) -> pa.Array:
    """Whole words looked up in the row's own fixes (a map has no hashed look-up in SQL).

    Few rows at a time are Python objects, whatever the size of the batch.
    """

    def corrected(text, fix):
        if fix is None or text is None:
            return text
        known = dict(fix)
        return _WORD.sub(lambda m: known.get(m[0].lower(), m[0]), text)

    parts = [
        pa.array(map(corrected, texts.slice(k, ROWS).to_pylist(), fixes.slice(k, ROWS).to_pylist()), pa.string())
        for k in range(0, len(texts), ROWS)
    ]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])
