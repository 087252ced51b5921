"""Benchmark decontamination by template canonicalisation.

Capitalised words (but for English words that start sentences), numbers and units become
typed placeholders, so a question that was copied with
other values has the template of the original. Windows of template words of documents and
benchmark items meet in a hash join; where a document's windows follow an item in step, the
values in the placeholders must be consistent: one value of the item stands for one value
of the document. Windows of the same words meet too, whatever their placeholders. A document is contaminated by an item if such windows cover at least a
given share of the item's words. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable

WINDOW = 8
SHORTEST = 4
SHARE = 0.5
BROADCAST_ROWS = 500_000

_NAME, _NUMBER, _UNIT, _LAST = "\x01", "\x02", "\x03", "\x04"
_NUMBER_WORDS = (
    "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|"
    "eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
)
_UNITS = (
    "mm|cm|m|km|mg|g|kg|ml|l|s|h|mph|kmh|inch|inches|foot|feet|yards?|miles?|meters?|metres?|kilometers?|kilometres?|"
    "centimeters?|centimetres?|grams?|kilograms?|pounds?|ounces?|tons?|liters?|litres?|gallons?|seconds?|minutes?|"
    "hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?"
)
#: English words that start sentences and are no names.
_STARTS = (
    "The|An|He|She|It|They|We|You|His|Her|Their|Its|My|Our|Your|This|That|These|Those|There|Then|If|In|On|At|Of|For|"
    "From|To|By|With|As|And|Or|But|So|When|While|What|Which|Who|Whom|Whose|Where|Why|How|Is|Are|Was|Were|Do|Does|Did|"
    "Has|Have|Had|Can|Could|Would|Should|Not|No|Each|Every|All|Some|Any|Both|After|Before|Because|Since|Until|Let|One"
)
#: Each in turn: what to find, what to put there. A mark stands before the word it types.
#: A word is typed by itself, wherever it stands; only a unit needs the number before it.
_STEPS = (
    (r"[\s\p{Z}\x01-\x04]{2,}+|[\s\p{Z}\x01-\x04&&[^ ]]", " "),
    (rf"(\p{{N}})({_UNITS})(?!\p{{L}})", "$1 $2"),
    (r"\p{N}(?<![\p{L}\p{N}]\p{N})(?<!\p{N}[.,:/]\p{N})\p{N}*+(?:[.,:/]\p{N}++)*+(?!\p{L})", f"{_NUMBER}$0"),
    (rf"(?<![\p{{L}}\p{{N}}])(?i:{_NUMBER_WORDS})(?![\p{{L}}\p{{N}}])", f"{_NUMBER}$0"),
    (rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}\x02]\p{{Lu}})\p{{Ll}}++\p{{L}}*+(?<!(?<!\p{{L}})(?:{_STARTS}))", f"{_NAME}$0"),
    (rf"(\x02[^\s\x01-\x03]++\s)((?i:{_UNITS})(?!\p{{L}}))", f"$1{_UNIT}$2"),
    (r"[^\p{L}\p{N}\s\x01-\x03](?!(?<=\p{N}.)\p{N})", " "),
)


def marked_words(text: Column) -> Column:
    """The words in lower case; a name, number or unit has its mark in front."""
    text = F.coalesce(text, F.lit(""))
    for find, put in _STEPS:
        text = F.regexp_replace(text, find, put)
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _parts(window: int) -> list[int]:
    """Window lengths whose hashes make those of all windows up to ``window``: 1, 2, 4, ..."""
    return [1 << k for k in range(window.bit_length())]


def _joined(a: str, b: str, apart: int) -> str:
    """A hash for each pair of an element of ``a`` and the one of ``b`` that lies ``apart`` places on."""
    n = f"greatest(size({b}) - {apart}, 0)"
    return f"zip_with(slice({a}, 1, {n}), slice({b}, {apart + 1}, {n}), (x, y) -> xxhash64(x, y))"


def _with_words(frame: DataFrame, window: int, *keep: str) -> DataFrame:
    """``keep``, the marked words ``w``, and hashes of runs of words: ``t1, t2, t4, ...`` of the
    template and ``p1, p2, p4, ...`` of the plain words. Each word is hashed once for each."""
    frame = frame.select(*keep, marked_words(F.col("text")).alias("w"))
    plain = F.transform("w", lambda x: F.xxhash64(F.ltrim(x, F.lit(_NAME + _NUMBER + _UNIT))))
    masked = F.transform("w", lambda x: F.xxhash64(F.when(x < _LAST, F.substring(x, 1, 1)).otherwise(x)))
    frame = frame.select(*keep, "w", masked.alias("t1"), plain.alias("p1"))
    for half in _parts(window)[:-1]:
        frame = frame.select("*", *(F.expr(_joined(f"{x}{half}", f"{x}{half}", half)).alias(f"{x}{2 * half}") for x in "tp"))
    return frame


def _hashes(words: str, size: int) -> str:
    """Hashes of all windows of a size: two overlapping runs of half of it or more."""
    part = 1 << size.bit_length() - 1
    return f"{words}{part}" if part == size else _joined(f"{words}{part}", f"{words}{part}", size - part)


def _whole() -> str:
    """The whole text as a window, if it is shorter than the shortest window."""
    return f"""if(size(w) between 1 and {SHORTEST - 1}, array(struct(0 as at, size(w) as size, xxhash64(p1) as hash,
        cast(array() as array<string>) as slots)), cast(array() as array<struct<at:int,size:int,hash:bigint,slots:array<string>>>))"""


def _windows(size: int) -> str:
    """All windows of the template with their place and the marked words in them; those with
    a marked word also as plain words, which must be the same and have no slots. Of windows
    of which more than half is marked, only the plain words."""
    slots = f"filter(slice(w, i + 1, {size}), x -> x < '{_LAST}')"
    return f"""concat(
        filter(transform({_hashes("t", size)}, (h, i) -> struct(i as at, {size} as size, h as hash, {slots} as slots)),
            x -> 2 * size(x.slots) <= {size}),
        filter(transform({_hashes("p", size)}, (h, i) -> struct(i as at, {size} as size,
            if(size({slots}) > 0, h, null) as hash, cast(array() as array<string>) as slots)), x -> x.hash is not null))"""


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_a`` and ``_b``, 128 bits that tell rows apart by doc_id and text."""
    return docs.withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64(F.lit(1), "doc_id", "text")})


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, exact``, one row per document and item
    of which the document holds at least ``share``; ``exact`` tells that no value differs.

    Where one value of the item stands in step for several values of the document, windows
    with that value count only if all their values are the item's.

    Items of fewer than ``window`` words are looked for as a whole; those of fewer than four
    match documents of just their words. Empty and null ones match nothing. Windows of the same words always match;
    with other values, those match of which at most half are placeholders. Null and empty documents hold nothing. Rows that repeat
    a doc_id, or have none, are documents of their own unless their texts are equal too;
    rows that repeat an item_id count as one item. Empty tables give no rows. Other columns
    are ignored.
    """
    return _contamination(docs, benchmark, window, share, broadcast_rows).drop("_a", "_b")


def _contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The result with the keys of the documents' rows."""
    items = durable(_with_words(benchmark, window, "item_id").where(F.size("w") > 0))
    sizes = [r[0] for r in items.select(F.least(F.size("w"), F.lit(window))).distinct().collect()]
    if not sizes:
        return _result(docs, benchmark)
    sizes = sorted(s for s in sizes if s >= SHORTEST)  # at most ``window`` sizes
    own_size = F.coalesce(*(F.when(F.least(F.size("w"), F.lit(window)) == s, F.expr(_windows(s))) for s in sizes), F.expr(_whole()))
    known = durable(items.select("item_id", F.size("w").alias("item_words"), F.inline(own_size)))
    hashes = known.select("hash").distinct()
    few = known.count() <= broadcast_rows

    def small(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if few else frame

    key = ["_a", "_b"]
    texts = _keyed(docs.select("doc_id", "text"))
    tokens = _with_words(texts, window, *key)
    whole = f"if(size(w) between 1 and {SHORTEST - 1}, array(xxhash64(p1)), cast(array() as array<bigint>))"
    all_hashes = F.expr(f"concat({', '.join([whole, *(_hashes(x, s) for s in sizes for x in 'tp')])})")
    hit = durable(tokens.select(*key, F.explode(all_hashes).alias("hash")).join(small(hashes), "hash", "left_semi")
                  .select(*key).distinct())
    suspects = texts.join(F.broadcast(hit) if hit.count() <= broadcast_rows else hit, key, "left_semi")
    key = [*key, "doc_id"]
    tokens = _with_words(suspects, window, *key)
    all_windows = F.expr(f"concat({', '.join([_whole(), *map(_windows, sizes)])})")
    found = tokens.select(*key, F.inline(all_windows)).withColumnRenamed("at", "doc_at").withColumnRenamed("slots", "doc_slots")
    found = durable(
        found.join(small(known), ["hash", "size"])
        .where(F.size("slots") == F.size("doc_slots"))
        .select(*key, "item_id", "item_words", "at", (F.col("doc_at") - F.col("at")).alias("shift"), "size", "slots", "doc_slots")
    )
    pair = ["_a", "_b", "item_id", "shift"]
    values = found.where(F.size("slots") > 0).select(*pair, F.inline(F.arrays_zip("slots", "doc_slots")))
    values = values.groupBy(*pair, "slots").agg(F.min("doc_slots").alias("a"), F.max("doc_slots").alias("b"))
    steps = values.groupBy(*pair).agg(
        F.collect_list(F.when(F.col("a") != F.col("b"), F.col("slots"))).alias("clash"),
        F.max((F.col("a") != F.col("slots")) | (F.col("b") != F.col("slots"))).alias("changed"),
    ).where("changed")
    match = found.join(
        steps.select(F.col("_a").alias("c"), F.col("_b").alias("d"), F.col("item_id").alias("i"), F.col("shift").alias("s"), "clash", "changed"),
        (found["_a"] == F.col("c")) & (found["_b"] == F.col("d")) & found.item_id.eqNullSafe(F.col("i"))
        & (found["shift"] == F.col("s")), "left",
    ).where((F.col("slots") == F.col("doc_slots")) | ~F.coalesce(F.arrays_overlap("slots", "clash"), F.lit(False)))
    words = match.select(
        *key, "item_id", "item_words", F.coalesce("changed", F.lit(False)).alias("changed"),
        F.explode(F.expr("sequence(at, at + size - 1)")).alias("word"),
    )
    words = words.groupBy(*key, "item_id", "word").agg(F.max("item_words").alias("item_words"), F.max("changed").alias("changed"))
    covered = words.groupBy(*key, "item_id").agg(
        F.max("item_words").alias("item_words"), F.count("*").alias("covered_words"), (~F.max("changed")).alias("exact")
    )
    return covered.where(F.col("covered_words") >= share * F.col("item_words"))


def _result(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """No rows."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame(
        [], f"_a long, _b long, doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, covered_words long, exact boolean"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Rows are removed by doc_id and text, so clean rows stay that share a doc_id with a
    contaminated one, or have none like it.
    """
    bad = _contamination(docs, benchmark, **options).select("_a", "_b").distinct()
    return _keyed(docs).join(bad, ["_a", "_b"], "left_anti").select(*docs.columns)
