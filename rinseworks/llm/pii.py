"""Personal data by candidate spans, boosted trees and a calibrated threshold.

Exact patterns with validation give the base spans, which always count. Generators with
high recall propose further, overlapping spans: digit groups in any layout and written-out
addresses. Boosted trees score each candidate by its format and the words around it; they
learn from the candidates that coincide with base spans of their kind and from those that
are known to be something else (dates, years, versions, numbers of orders, spans of other
kinds), with features that do not show what the exact patterns need. The threshold of each
kind is the lowest at which, on such candidates that training did not see, the wanted share
is right; candidates of neither sort are only scored. Everything is DataFrame
and SQL functions and the trees of Spark's own library.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98

#: Base patterns. Repetition is possessive and starts only where a run of characters does,
#: or where the match before it ended, so that long runs cost one pass; what they find is
#: what the plain patterns find.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CANDIDATES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().0-9/-]{5,})[0-9]",
}
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|address|mailto)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|dial|whatsapp|number)\W*$",
    "card": r"(?i)(?:card|visa|credit|account|payment|paid|iban)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|login)\W*$",
}
_DAY = r"(?:0?[1-9]|[12][0-9]|3[01])"
#: Formats and contexts of candidates that are known to be no personal data.
_OTHER = {
    "phone": (
        r"^(?:(?:19|20)[0-9]{2}([-/.])" + _DAY + r"\1" + _DAY + r"|" + _DAY + r"([-/.])" + _DAY + r"\2(?:(?:19|20)[0-9]{2}|[0-9]{2}))(?![0-9./-])",
        r"^\(?(?:19|20)[0-9]{2}\x20?[-/]\x20?(?:19|20)[0-9]{2}\)?$", r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$",
        r"^(?:[^0-9]*[0-9]){1,6}[^0-9]*$", r"^(?:[^0-9]*[0-9]){16}",
    ),
    "email": (r"(?:^|[^A-Za-z0-9-])[0-9-]++$",),
}
_NUMBER_OF = (
    r"(?i)(?<![A-Za-z])(?:order|invoice|article|item|serial|isbn|issn|sku|ticket|version|release|build|chapter|section|"
    r"pages?|pp|vol|volume|figure|table|dated?|born)\W*+(?:\w++\W++){0,2}$"
)
FEATURES = (
    "length", "digits", "letters", "blanks", "dashes", "dots", "brackets", "slashes",
    "groups", "longest_group", *(f"after_{k}" for k in KINDS), "letter_before", "letter_after",
    "digits_near", "number_like_before",
)


def _running(numbers: str) -> str:
    """Running sums of an array: in each step every element adds the one 1, 2, 4, ... before it."""
    return f"""if(size({numbers}) < 2, {numbers}, aggregate(sequence(0, int(ceil(log2(size({numbers})))) - 1), {numbers}, (s, k) ->
        zip_with(s, concat(array_repeat(0, shiftleft(1, k)), slice(s, 1, size(s) - shiftleft(1, k))), (a, b) -> a + b)))"""


def _located(text: str, pattern: str) -> Column:
    """Matches with start and end in code points, from running sums over them and the gaps between."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    gaps = f"split({text}, '{quoted}', -1)"
    return F.expr(f"""transform(array({found}), m -> if(size(m) = 0, cast(array() as array<struct<s:int,e:int,v:string>>),
        transform(array(zip_with(m, slice({gaps}, 1, size(m)), (x, g) -> char_length(g) + char_length(x))), n ->
            zip_with(m, {_running("n")}, (x, e) -> struct(e - char_length(x) as s, e as e, x as v)))[0]))[0]""")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_LUHN = """aggregate(sequence(1, char_length(d)), 0, (t, i) -> t + if(i % 2 = 1,
    int(substr(d, char_length(d) - i + 1, 1)),
    int(substr('0246813579', int(substr(d, char_length(d) - i + 1, 1)) + 1, 1)))) % 10 = 0"""


def _valid(kind: str) -> str:
    if kind == "ip":
        return f"rlike(x.v, '^{_OCTET}([.]{_OCTET}){{3}}$')"
    if kind == "card":
        return f"""exists(array({_digits('x.v')}), d -> if(char_length(d) between 13 and 19, {_LUHN}, false))"""
    if kind == "phone":
        return f"char_length({_digits('x.v')}) between 9 and 15"
    return "true"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with one array of ``(s, e, v)`` for each kind: what the exact patterns find
    and the checks confirm. A match that fails its check is dropped, not retried."""
    needs = {"email": "'%@%'", "phone": "'%+%'"}
    kind = "array<struct<s:int,e:int,v:string>>"
    out = docs
    for k in KINDS:
        found = F.when(
            F.expr(f"{text} like {needs[k]}") if k in needs else F.col(text).rlike("[0-9]"), _located(text, _BASE[k])
        ).otherwise(F.expr(f"cast(array() as {kind})"))
        out = out.withColumn(f"_{k}", found)
    return out.withColumns({f"_{k}": F.expr(f"filter(_{k}, x -> {_valid(k)})") for k in KINDS})


def _measured(text: str, kind: str) -> str:
    """Candidates of a kind with ``sure``, whether a base span overlaps, ``label``, 1 for a base
    span of the kind, 0 for what is known to be something else, else null, and features.

    Features are those of ``c.v``, the candidate without leading plus, with ``@`` and ``.`` for
    what stands for them: what the exact pattern needs is not to be seen."""
    overlaps = {k: f"exists(_{k}, b -> b.s < x.e and x.s < b.e)" for k in KINDS}
    overlap = " or ".join(overlaps.values())

    def rlike(value: str, pattern: str) -> str:
        return f"rlike({value}, '{pattern}')".replace("\\", "\\\\")

    other = " or ".join([*(rlike("c.v", x) for x in _OTHER[kind]), *(v for k, v in overlaps.items() if k != kind)])
    if kind == "phone":
        other += f" or ({rlike('c.b', _NUMBER_OF)} and not {rlike('c.b', _CONTEXT['phone'])})"
    label = f"case when {overlaps[kind]} then 1D when {other} then 0D end"
    plain = "regexp_replace(x.v, '^[(]?[+]+', '')"
    for word, sign in (("at", "@"), ("dot", ".")):
        plain = f"regexp_replace({plain}, '(?i)\\\\x20?[(\\\\[]{word}[)\\\\]]\\\\x20?', '{sign}')"

    def count(chars: str) -> str:
        return f"char_length(c.v) - char_length(regexp_replace(c.v, '[{chars}]', ''))"

    before, after = f"substr({text}, greatest(1, x.s - 29), least(30, x.s))", f"substr({text}, x.e + 1, 30)"
    groups = "filter(split(c.v, '[^0-9]+'), g -> g <> '')"
    values = [
        "char_length(c.v)", count("0-9"), count("A-Za-z"), count("\\\\x20"), count("-"), count("."), count("()"),
        count("/"), f"size({groups})", f"coalesce(array_max(transform({groups}, g -> char_length(g))), 0)",
        *(f"int(rlike(c.b, '{_CONTEXT[k]}'))".replace("\\W", "\\\\W") for k in KINDS),
        "int(rlike(c.b, '[A-Za-z]$'))", "int(rlike(c.a, '^[A-Za-z]'))",
        "(char_length(regexp_replace(concat(c.b, c.a), '[^0-9]', ''))) / 60.0", "int(rlike(c.b, '[0-9][^0-9]{1,3}$'))",
    ]
    fields = ", ".join(f"float({v}) as {f}" for f, v in zip(FEATURES, values))
    return f"""transform(_may_{kind}, x -> transform(array(struct({before} as b, {after} as a, {plain} as v)), c ->
        struct('{kind}' as kind, x.s as s, x.e as e, ({overlap}) as sure, {label} as label, {fields}))[0])"""


def find_spans(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The rows of ``docs`` without their text, with ``row``, a number of the row; ``base``,
    the base spans ``(kind, s, e)`` by kind and start; and ``spans``, all spans likewise.

    Positions count code points, ends are exclusive. A null text is empty; an empty one
    has no spans. Repeated rows and null keys are rows like others, an empty table gives no
    rows. Without both kinds of candidates the trees add nothing.
    """
    kind = "array<struct<s:int,e:int,v:string>>"
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = base_spans(rows)
    for k, pattern in _CANDIDATES.items():
        needs = F.expr("text like '%@%' or rlike(text, '[(\\\\[]at[)\\\\]]')") if k == "email" else F.col("text").rlike("[0-9]")
        rows = rows.withColumn(f"_may_{k}", F.when(needs, _located("text", pattern)).otherwise(F.expr(f"cast(array() as {kind})")))
    base = ", ".join(f"transform(_{k}, x -> struct({i} as kind, x.s as s, x.e as e))" for i, k in enumerate(KINDS))
    keep = [c for c in docs.columns if c != "text"]
    found = durable(rows.select(
        F.monotonically_increasing_id().alias("row"), *keep, F.expr(f"concat({base})").alias("base"),
        F.expr(f"concat({', '.join(_measured('text', k) for k in _CANDIDATES)})").alias("candidates"),
    ))
    # Row numbers are read back from the written table, so they stay the same.
    candidates = durable(found.select("row", F.inline("candidates")))
    fresh = _accepted(candidates, precision)
    empty = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")
    if fresh is None:
        return found.drop("candidates").withColumn("spans", F.col("base"))
    added = fresh.groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    return found.drop("candidates").join(added, "row", "left").select(
        "row", *keep, "base", F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans")
    )


def _accepted(candidates: DataFrame, precision: float) -> DataFrame | None:
    """Candidates beside the base spans whose score reaches the calibrated threshold.

    Every candidate with a label takes part: three of four parts train, one calibrates.
    """
    part = F.pmod(F.xxhash64("row", "s", "e"), F.lit(4))
    learning = durable(candidates.where("label is not null").withColumn("part", part))
    counts = {r.label: r["count"] for r in learning.where("part > 0").groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 10:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, seed=7, maxBins=32).fit(vector.transform(learning.where("part > 0")))

    def scored(frame: DataFrame) -> DataFrame:
        return trees.transform(vector.transform(frame)).withColumn("score", vector_to_array("probability")[1])

    steps = scored(learning.where("part = 0")).groupBy("kind", F.floor(F.col("score") * 200).alias("step")).agg(
        F.sum("label").alias("right"), F.count("*").alias("n")
    ).collect()  # at most 201 rows a kind
    thresholds = {}
    for kind in _CANDIDATES:
        right, n = 0.0, 0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            right, n = right + r.right, n + r.n
            if right >= precision * n:
                thresholds[kind] = max(r.step / 200, 0.5)
    if not thresholds:
        return None
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in thresholds.items()), F.lit(2.0))
    numbers = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    return scored(candidates.where("not sure and label is null")).where(F.col("score") >= least).select(
        "row", numbers.alias("kind"), "s", "e"
    )


def spans_text(spans: str) -> str:
    """SQL for ``kind:start:end``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')"


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    found = find_spans(docs.select("doc_id", "text"), **options)
    return found.select(
        "doc_id", *(F.expr(f"bigint(size(filter(base, x -> x.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.expr(spans_text("base")).cast("binary"), 256).alias("base_sha256"), F.expr(spans_text("spans")).alias("spans"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """The rows with each span of the text replaced by its kind in brackets.

    Overlapping spans are merged and take the kind of the first. Rows find their spans by
    doc_id and a hash of the text, so rows that repeat a doc_id, or have none, keep their own.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    found = find_spans(keyed, **options).where(F.size("spans") > 0)
    spans = found.groupBy(F.col("doc_id").alias("_key"), F.col("_hash").alias("_key_hash")).agg(
        F.max(F.struct(F.size("spans").alias("n"), F.col("spans").alias("x"))).alias("_most")
    ).select("_key", "_key_hash", F.col("_most.x").alias("_spans"))
    names = ", ".join(f"'{k.upper()}'" for k in KINDS)
    text = F.expr(f"""aggregate(array_sort(transform(_spans, x -> struct(x.s as s, x.e as e, x.kind as kind))),
        struct(0 as p, '' as t), (a, x) -> if(x.s >= a.p,
            struct(x.e as p, concat(a.t, substr(text, a.p + 1, x.s - a.p), '[', array({names})[x.kind], ']') as t),
            struct(greatest(a.p, x.e) as p, a.t as t)), a -> concat(a.t, substr(text, a.p + 1)))""")
    out = docs.join(
        spans, docs.doc_id.eqNullSafe(F.col("_key")) & (F.xxhash64(docs.text) == F.col("_key_hash")), "left"
    )
    return out.withColumn("text", F.when(F.col("_spans").isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns)
