"""Web pages to element rows.

Tag soup needs a tolerant reader, so the pages pass through Arrow batches to a small
parser built on the standard library; everything after that is DataFrame work. What
only counts tags stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.functions.expr import ref

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
ELEMENTS = (
    "type string, level string, text string, url string, ordinal bigint, table_id bigint, "
    "row_id bigint, data map<string,string>"
)
_ARROW = (*[pa.string()] * 4, *[pa.int64()] * 3, pa.map_(pa.string(), pa.string()))
#: Pages of a batch whose elements are Python objects at a time.
PAGES = 64


class _Outline(HTMLParser):
    """Text pieces of a page and the spans of its elements over them.

    An unclosed element lasts until an enclosing one ends, so it holds all text up to
    there; an end tag without a start is ignored.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.found: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        parents = [e for e in self.open if e["tag"] in ("table", "tr")]
        element = {
            "tag": tag,
            "href": dict(attrs).get("href") if tag == "a" else None,
            "linked": tag == "a" and any(name == "href" for name, _ in attrs),
            "start": len(self.pieces),
            "end": None,
            "inside": [id(e) for e in parents],
        }
        self.found.append(element)
        if tag in _VOID:
            element["end"] = element["start"]
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while True:
                element = self.open.pop()
                element["end"] = len(self.pieces)
                if element["tag"] == tag:
                    break

    def handle_data(self, data):
        if not any(e["tag"] in ("script", "style") for e in self.open):
            self.pieces.append(data)

    def read(self, page: str) -> "_Outline":
        self.feed(page)
        self.close()
        for element in self.open:
            element["end"] = len(self.pieces)
        self.open = []
        return self

    def text(self, element: dict) -> str:
        return "".join(self.pieces[element["start"] : element["end"]]).strip()

    def visible(self) -> str:
        """The text with each line end, and each run of two blanks or more, as one blank."""
        return re.sub(r"\s*(?:[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]|  )\s*", " ", "".join(self.pieces)).strip()


def _rows(page: str) -> list[tuple]:
    outline = _Outline().read(page)
    rows = []

    def simple(kind, wanted, level=False):
        chosen = [e for e in outline.found if e["tag"] in wanted and (kind != "link" or e["linked"])]
        for i, e in enumerate(chosen):
            if text := outline.text(e):
                rows.append((kind, e["tag"] if level else None, text, e["href"], i, None, None, None))

    simple("heading", _HEADINGS, level=True)
    simple("paragraph", ["p"])
    lines: dict[int, list[dict]] = {}
    values_of: dict[int, list[str]] = {}
    for e in outline.found:
        if e["tag"] == "tr":
            for parent in e["inside"]:
                lines.setdefault(parent, []).append(e)
        elif e["tag"] in ("td", "th"):
            for parent in e["inside"]:
                values_of.setdefault(parent, []).append(outline.text(e))
    for t, table in enumerate(e for e in outline.found if e["tag"] == "table"):
        cells = [values_of.get(id(r), []) for r in lines.get(id(table), [])]
        header = cells[0] if cells else []
        filled = [c for c in cells[1:] if c]
        for r, values in enumerate(filled):
            names = header if len(header) == len(values) else [f"col_{i}" for i in range(len(values))]
            data = dict(zip(names, values))
            rows.append(("table_row", None, " ".join(data.values()), None, None, t, r, data))
    simple("link", ["a"])
    return rows or [("text", None, outline.visible(), None, None, None, None, None)]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Element rows of batches of pages; few pages at a time are Python objects."""
    names = [part.strip().split()[0] for part in ELEMENTS.replace("map<string,string>", "map").split(",")]
    for batch in batches:
        for start in range(0, batch.num_rows, PAGES):
            pages = batch.slice(start, PAGES)
            found = [_rows(page) for page in pages.column("html").to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(row for rows in found for row in rows)))
            columns[-1] = [None if data is None else list(data.items()) for data in columns[-1]]
            arrays = [pages.column("key").take(at), *(pa.array(c, kind) for c, kind in zip(columns, _ARROW))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", *names])


def html_elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per heading, paragraph, table row and link, or one text row without any.

    ``ordinal`` numbers the elements of a type within the page, those without text
    included in the numbering but not in the result.
    """
    kind = df.schema[key].dataType.simpleString()
    return (
        df.where(ref(html).isNotNull())
        .select(ref(key).alias("key"), ref(html).alias("html"))
        .mapInArrow(_elements, f"key {kind}, {ELEMENTS}")
        .withColumnRenamed("key", key)
    )


def html_table_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """Table rows as maps from header to cell, or from ``col_i`` where the counts differ."""
    return html_elements(df, key, html).where(F.col("type") == "table_row").select(
        ref(key), "table_id", "row_id", "data", "text"
    )


def html_visible_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """The text of each page without scripts and styles, whitespace collapsed."""

    @F.pandas_udf("string")
    def visible(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else _Outline().read(page).visible())

    return df.select(ref(key), visible(ref(html)).alias("text"))


def html_link_stats(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Headings and links per page with the host of the page, counted in the JVM."""
    bare = F.regexp_replace(ref(html), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return df.select(
        ref(key),
        F.expr("parse_url(`{}`, 'HOST')".format(url.replace("`", "``"))).alias("host"),
        F.regexp_count(bare, F.lit(r"(?i)<h[1-6][\s>]")).cast("bigint").alias("headings"),
        F.regexp_count(bare, F.lit(r"(?i)<a\s[^>]*href")).cast("bigint").alias("links"),
    )


def html_host_stats(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Pages, headings and links per host."""
    return (
        html_link_stats(df, key, url, html)
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("headings").alias("headings"),
            F.sum("links").alias("links"),
        )
    )
