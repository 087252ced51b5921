"""Free text to tables: sections, pages, extracted patterns and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.functions import constants as K
from rinseworks.functions.expr import let, matches, ref, strip, words

PATTERNS = {
    "email": K.EMAIL,
    "phone": K.PHONE,
    "date": K.DATE,
    "number": K.NUMBER,
    "url": K.URL,
    "currency": K.CURRENCY,
}
_PLURALS = {
    "email": "emails", "phone": "phones", "date": "dates", "number": "numbers", "url": "urls",
    "currency": "currency",
}


def _filled_pieces(text: Column, separator: str) -> Column:
    pieces = F.transform(F.split(text, separator), strip)
    return F.filter(pieces, lambda p: p != "")


def _chunks(items: Column, size: Column, joiner: str) -> Column:
    """A non-empty array regrouped into joined runs of the given length."""
    starts = F.sequence(F.lit(1), F.size(items), size)
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, size), joiner))


def _lines(text: Column) -> Column:
    def grouped(lines):
        size = F.greatest(F.lit(5), F.floor(F.size(lines) / 10).cast("int"))
        return F.when(F.size(lines) > 10, _chunks(lines, size, "\n")).otherwise(lines)

    return let(_filled_pieces(text, "\n"), grouped)


def section_array(text: Column) -> Column:
    """Blank-line paragraphs; of a single paragraph its lines, in chunks if there are many."""
    return let(
        _filled_pieces(text, "\n\n"),
        lambda paragraphs: F.when(F.size(paragraphs) < 2, _lines(text)).otherwise(paragraphs),
    )


def _word_chunks(text: Column) -> Column:
    def grouped(parts):
        size = F.greatest(F.lit(100), F.floor(F.size(parts) / 5).cast("int"))
        return F.when(F.size(parts) > 0, _chunks(parts, size, " ")).otherwise(parts)

    return let(words(text), grouped)


def page_array(text: Column) -> Column:
    """Form-feed pages, else parts between two blank lines, else about five word chunks."""
    fed = F.filter(F.split(text, "\f"), lambda p: strip(p) != "")
    whole = let(
        _filled_pieces(text, "\n\n\n"),
        lambda gaps: F.when(F.size(gaps) == 1, _word_chunks(text)).otherwise(gaps),
    )
    return F.when(F.contains(text, F.lit("\f")), fed).otherwise(whole)


def split_sections(df: DataFrame, text: str, number: str = "section") -> DataFrame:
    """One row per section with its number from 1; text and number replace the column.

    A row without any text keeps one row with empty text and no number.
    """
    return _explode(df, text, section_array(ref(text)), number)


def split_pages(df: DataFrame, text: str, number: str = "page") -> DataFrame:
    return _explode(df, text, page_array(ref(text)), number)


def _explode(df: DataFrame, text: str, pieces: Column, number: str) -> DataFrame:
    others = [ref(c) for c in df.columns if c != text]
    return df.select(*others, F.posexplode_outer(pieces).alias("__at", "__piece")).select(
        *others,
        (F.col("__at") + 1).cast("bigint").alias(number),
        F.coalesce("__piece", F.lit("")).alias(text),
    )


def extract_patterns(df: DataFrame, text: str) -> DataFrame:
    """Widen rows by how often each pattern occurs and its first match; null if it does not."""
    held = df.withColumns({f"__{k}": matches(ref(text), p) for k, p in PATTERNS.items()})
    out = {}
    for k in PATTERNS:
        hits = F.size(f"__{k}").cast("bigint")
        out[f"{_PLURALS[k]}_found"] = F.when(hits > 0, hits)
        if k != "number":
            out[f"first_{k}"] = F.try_element_at(F.col(f"__{k}"), F.lit(1))
    return held.withColumns(out).drop(*[f"__{k}" for k in PATTERNS])


def extract_matches(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """``(key, position, match)``: all matches of one of the patterns, from position 1."""
    return df.select(
        ref(key), F.posexplode(matches(ref(text), PATTERNS[kind])).alias("at", "match")
    ).select(ref(key), (F.col("at") + 1).cast("bigint").alias("position"), "match")


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """Widen rows by the number of sentences and the mean word length."""
    sentences = F.size(
        F.filter(F.split(ref(text), r"\."), lambda s: strip(s) != "")
    )
    mean_length = let(
        words(ref(text)),
        lambda found: F.round(
            F.try_divide(
                F.aggregate(found, F.lit(0), lambda total, w: total + F.length(w)), F.size(found)
            ),
            2,
        ),
    )
    return df.withColumns(
        {
            "sentence_count": sentences.cast("bigint"),
            "avg_word_length": F.coalesce(mean_length, F.lit(0.0)),
        }
    )


def section_stats(df: DataFrame, text: str) -> DataFrame:
    """Sections with word and character counts and the patterns found in them."""
    counted = split_sections(df, text).withColumns(
        {
            "word_count": F.size(words(ref(text))).cast("bigint"),
            "char_count": F.length(ref(text)).cast("bigint"),
        }
    )
    return extract_patterns(counted, text)


def text_to_tabular(df: DataFrame, text: str, statistics: bool = True) -> DataFrame:
    """Drop rows with blank text and widen the rest by patterns and statistics."""
    filled = extract_patterns(df.where(strip(ref(text)) != ""), text)
    return text_statistics(filled, text) if statistics else filled
