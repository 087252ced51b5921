"""Word boxes (recognised words with position and confidence) to blocks and tables."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable
from rinseworks.functions import constants as K
from rinseworks.functions.expr import contains_any, let, ref, strip
from rinseworks.operators.sections import extract_patterns

def _joined(order: list[str], word: str) -> Column:
    """Words of a group in order, separated by blanks."""
    items = F.array_sort(F.collect_list(F.struct(*order, word)))
    return F.array_join(F.transform(items, lambda s: s[word]), " ")


def word_boxes_to_blocks(
    df: DataFrame, doc: str, line: str, word: str, text: str = "text", conf: str = "conf",
    patterns: bool = False,
) -> DataFrame:
    """Runs of confident, non-empty words as blocks with their mean confidence.

    ``(doc, block, text, confidence, word_count)`` in reading order by line and word. The
    run a word belongs to is the number of breaks before it in its document. Words are sorted
    by range, so documents and lines of any length spread over tasks; breaks are counted
    within each part of a document, and a row for each part gives the breaks before it.
    """
    key = ["doc", "line", "word"]
    marked = df.select(
        ref(doc).alias("doc"), ref(line).alias("line"), ref(word).alias("word"),
        strip(ref(text)).alias("text"), ref(conf).cast("double").alias("conf"),
    ).withColumn(
        "good", F.coalesce((F.col("text") != "") & (F.col("conf") > 30), F.lit(False))
    )
    placed = durable(
        marked.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("place", 33))
    breaks = F.sum((~F.col("good")).cast("bigint"))
    earlier = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("doc", "part").agg(breaks.alias("inside"))
    before = F.coalesce(F.sum("inside").over(earlier), F.lit(0))
    offsets = parts.select(F.col("doc").alias("d"), F.col("part").alias("p"), before.alias("before"))
    within = Window.partitionBy("doc", "part").orderBy("place")
    runs = placed.withColumn("run", breaks.over(within)).where("good").join(
        offsets, F.col("doc").eqNullSafe(F.col("d")) & (F.col("part") == F.col("p"))
    )
    blocks = runs.groupBy("doc", (F.col("run") + F.col("before")).alias("run")).agg(
        _joined(["place"], "text").alias("text"),
        F.avg("conf").alias("confidence"),
        F.count(F.lit(1)).alias("word_count"),
    )
    out = blocks.select(
        F.col("doc").alias(doc), F.col("run").alias("block"), "text", "confidence", "word_count"
    )
    return extract_patterns(out, "text") if patterns else out


@lru_cache(1 << 14)
def _closest(name: str, cutoff: float) -> str | None:
    """The expected column with the most similar name, if one is similar enough."""
    return next(iter(difflib.get_close_matches(name, K.ORDER_COLUMNS, n=1, cutoff=cutoff)), None)


@lru_cache(1 << 14)
def _unique_names(names: tuple[str, ...]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in (_closest(x, 0.6) or x for x in names):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _header_names(headers: pd.Series) -> pd.Series:
    """Names close to an expected one take it; repeated names get a number."""
    return headers.map(lambda names: _unique_names(tuple(names)))


def _header_cells(words: Column) -> Column:
    """Words of the header line merged into cells ``(name, low, high)``."""

    def add(cells, word):
        last = F.element_at(cells, -1)
        right = word["left"] + word["width"]
        joins = (F.size(cells) > 0) & (word["left"] - F.get(cells, F.size(cells) - 1)["high"] <= 18)
        grown = F.struct(
            F.concat_ws(" ", last["name"], word["text"]).alias("name"),
            last["low"].alias("low"),
            right.alias("high"),
        )
        fresh = F.struct(word["text"].alias("name"), word["left"].alias("low"), right.alias("high"))
        return F.when(
            joins, F.concat(F.slice(cells, F.lit(1), F.size(cells) - 1), F.array(grown))
        ).otherwise(F.concat(cells, F.array(fresh)))

    none = F.array().cast("array<struct<name:string,low:double,high:double>>")
    return F.aggregate(words, none, add)


def word_boxes_to_table(df: DataFrame, doc: str) -> DataFrame:
    """``(doc, block_num, par_num, line_num, column, value)``: cells of the table on a page.

    The input has ``block_num, par_num, line_num, left, top, width, conf, text``. The
    header is the line with most words among the five top-most; its words merge into one
    header cell when at most 18 apart. Words of lower lines go to the header cell that
    contains their centre, else to the nearest. Pages with fewer than eight confident
    words or two header cells have no table. A line is one row, as it is in the result, and
    is shuffled twice, as words and by page; the lines of a page pass through one task in
    order and are never held together.
    """
    return _table_cells(df, doc).where(F.col("value") != "").drop("position").withColumnRenamed("doc", doc)


def _table_lines(df: DataFrame, doc: str) -> DataFrame:
    """Lines of the tables with their ``cells (column, value, position)``, empty ones too."""
    line = ["doc", "block_num", "par_num", "line_num"]
    words = df.select(
        ref(doc).alias("doc"),
        "block_num",
        "par_num",
        "line_num",
        *[F.coalesce(ref(c).cast("double"), F.lit(0.0)).alias(c) for c in ("left", "top", "width")],
        "text",
    ).where(
        F.col("doc").isNotNull()
        & (F.coalesce(ref("conf").cast("double"), F.lit(-1.0)) > 35) & (strip(ref("text")) != "")
    )

    def median(tops):
        low, high = F.get(tops, F.floor((F.size(tops) - 1) / 2).cast("int")), F.get(tops, F.floor(F.size(tops) / 2).cast("int"))
        return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)

    lines = words.groupBy(*line).agg(
        F.array_sort(F.collect_list(F.struct("left", "text", "width"))).alias("words"),
        F.sort_array(F.collect_list("top")).alias("tops"),
    ).select(*line, "words", median(F.col("tops")).alias("line_top"), F.size("words").alias("line_words"))
    from_top = Window.partitionBy("doc").orderBy("line_top", "block_num", "par_num", "line_num")
    page = from_top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.struct("block_num", "par_num", "line_num", "line_top", "words")
    first = F.when(F.col("place") <= 5, F.struct((-F.col("line_words")).alias("w"), F.col("place")))
    headed = (
        lines.withColumn("place", F.row_number().over(from_top))
        .withColumns({"h": F.min_by(title, first).over(page), "n": F.sum("line_words").over(page)})
        .where((F.col("n") >= 8) & F.col("h.block_num").isNotNull() & F.col("h.par_num").isNotNull() & F.col("h.line_num").isNotNull())
        .withColumn("header_top", F.col("h.line_top"))
        .withColumn("found", F.when(F.col("place") == 1, _header_cells(F.col("h.words"))))
        .drop("h", "n")
    )
    # The first line of a page hands its header's cells on to the others.
    so_far = from_top.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid_out = headed.withColumn("found", F.first("found").over(so_far)).where(
        (F.size("found") >= 2) & (F.col("line_top") > F.col("header_top") + 2)
    ).withColumn("names", _header_names(F.transform("found", lambda c: strip(c["name"]))))

    def column_of(word):
        centre = word["left"] + word["width"] / 2
        gaps = F.transform(
            "found", lambda c: F.greatest(c["low"] - centre, centre - c["high"], F.lit(0.0))
        )
        return let(gaps, lambda g: F.get("names", F.array_position(g, F.array_min(g)).cast("int") - 1))

    def cells(placed):
        def cell(name, position):
            here = F.filter(placed, lambda w: w["column"] == name)
            text = F.array_join(F.transform(here, lambda w: w["text"]), " ")
            return F.struct(name.alias("column"), text.alias("value"), position.alias("position"))

        return F.transform("names", cell)

    placed = F.transform("words", lambda w: F.struct(column_of(w).alias("column"), w["text"].alias("text")))
    return laid_out.select(*line, let(placed, cells).alias("cells"))


def _table_cells(df: DataFrame, doc: str) -> DataFrame:
    """All cells of the tables, empty ones too, with the ``position`` of their column."""
    return _table_lines(df, doc).select("doc", "block_num", "par_num", "line_num", F.inline_outer("cells"))  # never empty; outer, as the cells are then computed once


# --- roles of the columns of an order table ----------------------------------


def _as_number(v: Column) -> Column:
    """A number with or without thousands commas; the pattern keeps casts from failing.

    A gap, which is the text ``nan`` here, is a number that is not finite.
    """
    plain = F.replace(v, F.lit(","), F.lit(""))
    return F.when(F.lower(v) == "nan", F.lit(float("nan"))).when(
        plain.rlike(K.NUMERIC_LITERAL), plain.try_cast("double")
    )


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
    "nov(?:ember)?|dec(?:ember)?)"
)
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_TIME = r"(?:(?:t|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*([ap]m)?\s*(z|utc|[-+]\d{2}:?\d{2})?)?$"
#: Patterns with the groups of year, first and second part of the date, and of the first part of the time.
_DATES = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, 1, 3, 4, 5),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME, 4, 1, 3, 5),
    (r"^(?:[a-z]{3,9},?\s+)?" + _DAY + r"[-\s]" + _MONTH + r"\.?,?[-\s](\d{4})" + _TIME, 3, 2, 1, 4),
    (r"^(?:[a-z]{3,9},\s+)?" + _MONTH + r"\.?\s+" + _DAY + r",?\s+(\d{4})" + _TIME, 3, 1, 2, 4),
)


def parsed_date(v: Column) -> Column:
    """A date in one of the usual orders, with or without a time and a zone; else null.

    Year first, or the year last with the month before the day unless only the other order is
    a date, or with the month's name before or after the day. Separators are ``-``, ``/`` or
    ``.``; a time follows a ``T``, a comma or blanks, may have a fraction and am or pm, and with
    a zone is an instant. The parts come from the tokens of one pattern for each order, tested
    first, and are checked by the calendar.
    """

    def read(low: Column) -> Column:
        found = []
        for pattern, year, first, second, time in _DATES:
            part = lambda i: F.regexp_extract(low, pattern, i)  # noqa: E731, B023
            number = lambda i: part(i).try_cast("int")  # noqa: E731, B023
            a, b = number(first), number(second)
            if _MONTH in pattern:
                month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(part(first), 1, 3)).cast("int")
                day = b
            elif year > first:  # year last: the day may come first
                swap = (a > 12) & (b <= 12)
                month, day = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
            else:
                month, day = a, b
            half = part(time + 3)
            hour = F.coalesce(number(time), F.lit(0))
            hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
            minute = F.coalesce(number(time + 1), F.lit(0))
            second_ = F.coalesce(part(time + 2).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
            zone = part(time + 4)
            digits = F.regexp_replace(zone, "[^0-9]", "")
            offset = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")).cast("bigint")
            offset = F.coalesce(offset, F.lit(0)) * F.when(zone.startswith("-"), -1).otherwise(1)
            plain = F.try_make_timestamp(number(year), month, day, hour, minute, second_)
            instant = F.try_make_timestamp(number(year), month, day, hour, minute, second_, F.lit("UTC"))
            instant = F.timestamp_micros(F.unix_micros(instant) - offset * 60_000_000)
            found.append(F.when(low.rlike(pattern), F.when(zone == "", plain).otherwise(instant)))
        return F.coalesce(*found)

    return F.when(F.length(v) >= 8, let(F.lower(v), read))  # the shortest date is 1/1/2024


def _facts(v: Column) -> Column:
    """What the role tests need to know of a value, found once per value."""
    low = F.lower(v)
    return F.struct(
        (F.contains(v, F.lit("ORD")) & v.rlike(K.ORDER_ID)).alias("order"),  # plain searches first, they are cheap
        (F.contains(v, F.lit("CUST")) & v.rlike(K.CUSTOMER_ID)).alias("customer"),
        parsed_date(v).isNotNull().alias("date"),
        contains_any(low, K.PAYMENT_WORDS).alias("payment"),
        contains_any(low, K.CATEGORY_WORDS).alias("category"),
        _as_number(v).alias("number"),
    )


def _role_tests(facts: Column) -> dict[str, Column]:
    number = facts["number"]
    numeric = number.isNotNull()
    whole = numeric & ~F.isnan(number) & (number == F.floor(number)) & (number >= 0) & (number < 200)
    taken = facts["order"] | facts["customer"] | facts["date"] | facts["payment"] | numeric
    return {
        "Order ID": facts["order"],
        "Customer ID": facts["customer"],
        "Order Date": facts["date"],
        "Payment Method": facts["payment"],
        "Quantity": whole,
        "Price": numeric,
        "Order Total": numeric,
        "Category": facts["category"],
        "Item": ~taken,
    }


def role_shares(df: DataFrame) -> DataFrame:
    """``(column, role, share)``: how many values of each column look like each role.

    Nulls count as numbers, hence as prices and totals, but as no quantity and no item.
    """
    known = df.select(
        *[
            _facts(strip(F.coalesce(ref(c).cast("string"), F.lit("nan")))).alias(f"f{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(role).alias("role"),
            F.avg(F.coalesce(test, F.lit(False)).cast("double")).alias("share"),
        )
        for i, c in enumerate(df.columns)
        for role, test in _role_tests(F.col(f"f{i}")).items()
    ]
    return known.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _named_roles(columns: list[str]) -> dict[str, str]:
    """Role -> column by similar names, the first column of a role."""
    roles: dict[str, str] = {}
    for c in columns:
        near = _closest(c, 0.72)
        if near:
            roles.setdefault(near, c)
    return roles


def _shared_roles(roles: dict[str, str], left: list[str], share: dict[tuple[str, str], float]) -> dict[str, str]:
    """The roles with, role by role, the best of the columns left if it is above half."""
    roles, left = dict(roles), list(left)
    for role in K.ROLE_ORDER:
        if role in roles or not left:
            continue
        best = max(left, key=lambda c: share[role, c])
        if share[role, best] >= 0.5:
            roles[role] = best
            left.remove(best)
    return roles


def infer_column_roles(df: DataFrame) -> dict[str, str]:
    """Role -> column: similar names first, then role by role the best column above half."""
    roles = _named_roles(df.columns)
    left = [c for c in df.columns if c not in roles.values()]
    if not left:
        return roles
    share = {
        (r["role"], r["column"]): r["share"] or 0.0
        for r in role_shares(df.select(*[ref(c) for c in left])).collect()  # roles x columns
    }
    return _shared_roles(roles, left, share)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _page_roles(columns: pd.Series) -> pd.Series:
    """The position of each role's column on each page, null without one, from the names and
    shares of the page's columns in order."""

    def choose(page) -> list[int | None]:
        place = {c["column"]: c["position"] for c in page}
        names = [c["column"] for c in page]
        roles = _named_roles(names)
        share = {(role, c["column"]): s for c in page for role, s in zip(K.ROLE_ORDER, c["shares"])}
        roles = _shared_roles(roles, [n for n in names if n not in roles.values()], share)
        return [place.get(roles.get(role)) for role in K.ORDER_COLUMNS]

    return columns.map(choose)


def page_order_tables(df: DataFrame, doc: str) -> DataFrame:
    """The order table of every page: ``(doc, block_num, par_num, line_num)`` and the nine columns.

    Cells are those of :func:`word_boxes_to_table`. Each page infers the roles of its own
    columns, all pages in one plan: shares are aggregated by page and column, a page's few
    columns choose their roles, and each line, which is one row with all its cells, takes its
    values by role, typed and cleaned as by :func:`normalize_order_table`. Columns without a role are
    left out; pages without a table have no rows.
    """
    line = ["doc", "block_num", "par_num", "line_num"]
    lines = durable(_table_lines(df, doc))
    facts = lines.select("doc", F.inline("cells")).select("doc", "column", "position", _facts(strip(F.col("value"))).alias("f"))
    tests = _role_tests(F.col("f"))
    shares = [F.avg(F.coalesce(tests[role], F.lit(False)).cast("double")) for role in K.ROLE_ORDER]
    columns = facts.groupBy("doc", "column").agg(F.min("position").alias("position"), F.array(*shares).alias("shares"))
    pages = columns.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("position", "column", "shares"))).alias("columns"))
    named = lines.join(pages.select("doc", _page_roles("columns").alias("roles")), "doc")

    value = [F.get("cells", F.get("roles", F.lit(i)))["value"] for i in range(len(K.ORDER_COLUMNS))]
    pivoted = named.select(*line, *[F.coalesce(v, F.lit("")).alias(role) for v, role in zip(value, K.ORDER_COLUMNS)])
    table = normalize_order_table(pivoted, {role: role for role in K.ORDER_COLUMNS}, keep=tuple(line))
    return table.withColumnRenamed("doc", doc)


def normalize_order_table(
    df: DataFrame, roles: dict[str, str] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The order table with its nine columns in order, typed and cleaned.

    Stray tokens in number columns move to the item, numbers are the first one in the
    text, payment names are unified, rows with neither id nor item are dropped. Columns
    named in ``keep`` pass through.
    """
    roles = infer_column_roles(df) if roles is None else roles
    v = {
        role: strip(F.coalesce(ref(roles[role]).cast("string"), F.lit("nan")))
        if role in roles
        else F.lit("")
        for role in K.ORDER_COLUMNS
    }
    item = v["Item"]
    numbers = {}
    for role in ("Quantity", "Price", "Order Total"):
        token = F.lower(v[role])
        stray = token.isin(K.STRAY_TOKENS)
        item = F.when(stray, strip(F.concat_ws(" ", item, token))).otherwise(item)
        first = F.regexp_extract(v[role], K.FIRST_NUMBER, 0)
        numbers[role] = F.when(~stray & (first != ""), first.try_cast("double"))
    low = F.lower(v["Payment Method"])
    payment = v["Payment Method"]
    for part, name in reversed(K.PAYMENT_NAMES):
        payment = F.when(F.contains(low, F.lit(part)), name).otherwise(payment)

    def filled(c):
        return F.when(c != "", c)

    columns = {
        "Order ID": filled(v["Order ID"]),
        "Customer ID": filled(v["Customer ID"]),
        "Category": filled(v["Category"]),
        "Item": filled(item),
        **{role: numbers[role] for role in ("Price", "Quantity", "Order Total")},
        "Order Date": parsed_date(v["Order Date"]),
        "Payment Method": filled(payment),
    }
    out = df.select(
        *[ref(c) for c in keep], *[columns[role].alias(role) for role in K.ORDER_COLUMNS]
    )
    return out.where(ref("Order ID").isNotNull() | ref("Item").isNotNull())
