"""Profiling, detection and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinseworks.frames import small_frame
from rinseworks.functions import constants as K
from rinseworks.operators import (
    audit,
    consistency,
    duplicates,
    forest,
    missing,
    outliers,
    profile,
    quality,
    similarity,
    spelling,
)
from rinseworks.plans import engine
from workload.catalog import COLUMNS, core, each, query, quote, rounded, strip_sql, with_view
from workload.views import sql_view

NUM, TEXT, ALL = 0, 1, 2


def cols(view: str, kind: int) -> list[str]:
    return COLUMNS[view][kind]


def all_list(view: str) -> str:
    return ", ".join(cols(view, ALL))


def dup_cte(view: str, name: str = "dup", source: str = "v") -> str:
    return (
        f"{name} as (select (select count(*) from {source}) as n, coalesce(sum(k - 1), 0)::bigint as d "
        f"from (select count(*) as k from {source} group by {all_list(view)}) g)"
    )


def iqr_cte(columns: list[str], name: str = "iqr", source: str = "v") -> str:
    """Per column: rows, values, quartiles, moments and outlier counts."""
    stats = each(
        columns,
        f"select '{{c}}' as c, count(*) as n, count({{c}}) as present, "
        f"quantile_cont({{c}}::double, 0.25) as q1, quantile_cont({{c}}::double, 0.75) as q3, "
        f"avg({{c}}::double) as mean, stddev_pop({{c}}::double) as sd from {source}",
    )
    values = each(columns, f"select '{{c}}' as c, {{c}}::double as x from {source}")
    return (
        f"{name}_s as ({stats}), {name}_x as ({values}), "
        f"{name} as (select s.c, any_value(s.n) as n, any_value(s.present) as present, "
        "any_value(s.q1) as q1, any_value(s.q3) as q3, "
        "count(*) filter (x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outside, "
        "count(*) filter ((x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) "
        "and sd > 0 and abs(x - mean) / sd > 3) as far "
        f"from {name}_s s join {name}_x x on s.c = x.c group by s.c)"
    )


# --- profiling ---------------------------------------------------------------


@query(
    with_view("dirty_customer")
    + "select "
    + ", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in cols("dirty_customer", ALL))
    + " from v order by c_custkey limit 50".replace("order by c_custkey", "order by v.c_custkey")
)
def data_preview(t):
    return audit.data_preview(t.dirty_customer, "c_custkey", 50)


@query(
    "select sha256(text) as fingerprint, min(doc_id) as first_key, count(*) as copies "
    "from documents group by 1"
)
def content_fingerprint(t):
    return duplicates.content_fingerprint(t.documents, "doc_id", "text")


@query(
    with_view("dirty_orders", dup_cte("dirty_orders"))
    + "select n as total_rows, 6::bigint as total_columns, (select "
    + " + ".join(f"sum(case when {c} is null then 1 else 0 end)" for c in cols("dirty_orders", ALL))
    + " from v)::bigint as missing_values, d as duplicates, 4::bigint as numeric_columns, "
    "2::bigint as text_columns from dup"
)
def dataset_stats(t):
    return profile.dataset_stats(t.dirty_orders)


def _profile_sql():
    kinds = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
    parts = []
    for i, c in enumerate(cols("lineitem", ALL)):
        number = c in cols("lineitem", NUM)
        value = f"{c}::double" if number else "null::double"
        parts.append(
            f"select {i} as position, '{c}' as \"column\", '{kinds.get(c, 'double')}' as data_type, "
            f"count(distinct {c}) as unique_values, count(*) - count({c}) as null_count, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 4)::double as null_percentage, "
            f"min({value}) as minimum, max({value}) as maximum, round(avg({value}), 4) as mean, "
            f"round(stddev_samp({value}), 4) as std from lineitem"
        )
    return "\nunion all ".join(parts)


@query(_profile_sql())
def column_profile(t):
    return rounded(profile.column_profile(t.lineitem), "null_percentage", "mean", "std")


@query(
    with_view("dirty_customer", "d as ("
    + each(cols("dirty_customer", ALL),
           "select distinct '{c}' as \"column\", cast({c} as varchar) as value from v where {c} is not null")
    + ")")
    + 'select "column", rank, value from (select *, row_number() over (partition by "column" order by value) '
    "as rank from d) r where rank <= 5"
)
def column_samples(t):
    return profile.column_samples(t.dirty_customer)


def _missing_sql(view, extra="count(*) - count({c})"):
    return "\nunion all ".join(
        f"select {i} as position, '{c}' as c, count(*) as n, {extra.replace('{c}', c)} as m from v"
        for i, c in enumerate(cols(view, ALL))
    )


@query(
    with_view("dirty_orders", f"m as ({_missing_sql('dirty_orders')})")
    + 'select position, c as "column", n as total, m as missing from m'
)
def missing_counts(t):
    return profile.missing_counts(t.dirty_orders)


@query(with_view("dirty_orders", dup_cte("dirty_orders")) + "select n as total_rows, d as duplicates from dup")
def duplicate_row_count(t):
    return duplicates.duplicate_row_count(t.dirty_orders)


@query(with_view("events", iqr_cte(cols("events", NUM))) + 'select c as "column", outside as outliers from iqr')
def iqr_outlier_counts(t):
    return profile.iqr_outlier_counts(t.events)


@query(
    with_view("dirty_orders", dup_cte("dirty_orders"), iqr_cte(cols("dirty_orders", NUM)),
              f"m as ({_missing_sql('dirty_orders')})")
    + "select n as total_rows, 6::bigint as total_columns, "
    "round(100.0 * (select sum(m) from m) / (n * 6), 4)::double as missing_percentage, "
    "round(100.0 * d / n, 4)::double as duplicate_percentage, "
    "(select sum(outside) from iqr)::bigint as total_outliers from dup"
)
def profile_summary(t):
    return rounded(profile.profile_summary(t.dirty_orders), "missing_percentage", "duplicate_percentage")


# --- detectors ---------------------------------------------------------------


def ladder(p: str, high=None, medium=None) -> str:
    out = "case "
    if high is not None:
        out += f"when {p} > {high} then 'high' "
    if medium is not None:
        out += f"when {p} > {medium} then 'medium' "
    return out + "else 'low' end"


def issue(kind: str, column: str, rows: str, share: str, severity: str, tail: str) -> str:
    return (
        f"select '{kind}' as issue_type, {column} as \"column\", ({rows})::bigint as affected_rows, "
        f"round(({share})::double, 4) as percentage, {severity} as severity {tail}"
    )


def missing_issue(source: str = "m") -> str:
    p = "100.0 * m / n"
    return issue("missing_values", "c", "m", p, ladder(p, 50, 20), f"from {source} where m > 0")


@query(with_view("dirty_orders", f"m as ({_missing_sql('dirty_orders')})") + missing_issue())
def detect_missing(t):
    return core(missing.detect_missing(t.dirty_orders))


@query(
    with_view("gappy_orders", f"m as ({_missing_sql('gappy_orders')})")
    + issue("empty_column", "c", "n", "100.0", "'high'", "from m where m = n")
)
def detect_empty_columns(t):
    return core(missing.detect_empty_columns(t.gappy_orders))


@query(
    with_view("gappy_orders", "e as (select ("
    + " + ".join(f"({c} is null)::int" for c in cols("gappy_orders", ALL))
    + ") / 6.0 > 0.8 as empty from v)", "s as (select count(*) as n, count(*) filter (empty) as m from e)")
    + issue("mostly_empty_rows", "null::varchar", "m", "100.0 * m / n", "'medium'", "from s where m > 0")
)
def detect_mostly_empty_rows(t):
    return core(missing.detect_mostly_empty_rows(t.gappy_orders))


def duplicate_issue(source: str = "dup") -> str:
    p = "100.0 * d / n"
    return issue("exact_duplicates", "null::varchar", "d", p, ladder(p, 10, 5), f"from {source} where d > 0")


@query(with_view("dirty_orders", dup_cte("dirty_orders")) + duplicate_issue())
def detect_exact_duplicates(t):
    return core(duplicates.detect_exact_duplicates(t.dirty_orders))


def column_duplicate_cte(columns):
    return "cd as (" + each(
        columns,
        "select '{c}' as c, sum(k)::bigint as n, sum(k - 1)::bigint as d "
        "from (select count(*) as k from v group by {c}) g",
    ) + ")"


COLUMN_DUPLICATES = issue("column_duplicates", "c", "d", "100.0 * d / n", "'low'", "from cd where d > 0 and d < 0.8 * n")


@query(
    with_view("dirty_orders", column_duplicate_cte(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "sparse_num"]))
    + COLUMN_DUPLICATES
)
def detect_column_duplicates(t):
    return core(duplicates.detect_column_duplicates(t.dirty_orders))


@query(
    with_view("dirty_customer", "g as ("
    + each(cols("dirty_customer", TEXT),
           f"select '{{c}}' as c, lower({strip_sql('{c}')}) as f, count(*) as k from v where {{c}} is not null group by 2")
    + ")", "s as (select c, sum(k - 1) as d, sum(k) as n from g where k > 1 group by c)")
    + issue("normalized_duplicates", "c", "d", "100.0 * d / n", "'low'", "from s")
)
def detect_normalized_duplicates(t):
    return core(duplicates.detect_normalized_duplicates(t.dirty_customer))


@query(
    with_view("events", iqr_cte(["value"]))
    + "select v.event_id, v.value from v, iqr where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)"
)
def iqr_flags(t):
    return outliers.iqr_flags(t.events.select("event_id", "value"), "value")


@query(
    "select event_id, value from events, (select avg(value) as m, stddev_pop(value) as s from events) z "
    "where abs(value - m) / s > 3"
)
def zscore_flags(t):
    return outliers.zscore_flags(t.events.select("event_id", "value"), "value")


def outlier_issue(source: str = "iqr") -> str:
    p = "100.0 * far / n"
    return issue("numeric_outliers", "c", "far", p, ladder(p, 10, 5),
                 f"from {source} where far > 0 and (n - present) * 2 <= n")


@query(with_view("dirty_orders", iqr_cte(cols("dirty_orders", NUM))) + outlier_issue())
def detect_numeric_outliers(t):
    return core(outliers.detect_numeric_outliers(t.dirty_orders))


@query()
def isolation_forest_flags(t):
    rows = t.events.select("event_id", "user_id", "value")
    return rounded(forest.isolation_forest_flags(rows, ["user_id", "value"]), "anomaly_score")


@query(
    with_view("dirty_customer", "f as ("
    + each(cols("dirty_customer", TEXT),
           "select '{c}' as c, {c} as x, count(*) as k, sum(count(*)) over () as n from v where {c} is not null group by {c}")
    + ")", "s as (select c, sum(k) as r, max(n) as n from f where k * 1.0 / n < 0.01 group by c)")
    + issue("rare_categories", "c", "r", "100.0 * r / n", "'low'", "from s")
)
def detect_rare_categories(t):
    return core(outliers.detect_rare_categories(t.dirty_customer))


def pattern_cte(view: str) -> str:
    """Per text column, how many values show each trait."""
    text = "select '{c}' as c, count({c}) as n, "
    for i, p in enumerate(K.DATE_FORMATS.values()):
        text += f"count(*) filter (regexp_matches({{c}}, {quote(p)})) as d{i}, "
    for name, p in (("comma", K.COMMA_DECIMAL), ("dot", K.DOT_DECIMAL), ("cur", K.CURRENCY_SYMBOL),
                    ("wide", K.NON_ASCII)):
        text += f"count(*) filter (regexp_matches({{c}}, {quote(p)})) as {name}, "
    text += f"count(*) filter ({strip_sql('{c}')} <> {{c}}) as outer_space, "
    text += "count(*) filter (" + " or ".join(f"contains({{c}}, {quote(m)})" for m in K.MOJIBAKE) + ") as marks from v"
    return "t as (" + each(cols(view, TEXT), text) + ")"


DATES = "d0 + d1 + d2 + d3"
DATE_KINDS = "(d0 > 0)::int + (d1 > 0)::int + (d2 > 0)::int + (d3 > 0)::int"
MIXED_DATES = issue("inconsistent_date_format", "c", DATES, f"100.0 * ({DATES}) / n", "'medium'", f"from t where {DATE_KINDS} > 1")
MIXED_DECIMALS = issue("inconsistent_decimal_separator", "c", "comma + dot", "100.0 * (comma + dot) / n", "'medium'",
                       "from t where comma > 0 and dot > 0")
CURRENCY = issue("currency_in_numeric", "c", "cur", "100.0 * cur / n", "'low'", "from t where cur > 0")
WHITESPACE = issue("leading_trailing_whitespace", "c", "outer_space", "100.0 * outer_space / n", "'low'",
                   "from t where outer_space > 0")
WIDE = issue("non_ascii_characters", "c", "wide", "100.0 * wide / n", "'low'", "from t where wide > 0")


@query(with_view("dirty_customer", pattern_cte("dirty_customer")) + MIXED_DATES)
def detect_mixed_date_formats(t):
    return core(consistency.detect_mixed_date_formats(t.dirty_customer))


@query(with_view("dirty_customer", pattern_cte("dirty_customer")) + MIXED_DECIMALS)
def detect_mixed_decimal_separator(t):
    return core(consistency.detect_mixed_decimal_separator(t.dirty_customer))


@query(with_view("dirty_customer", pattern_cte("dirty_customer")) + CURRENCY)
def detect_currency_symbols(t):
    return core(consistency.detect_currency_symbols(t.dirty_customer))


@query(with_view("dirty_customer", pattern_cte("dirty_customer")) + WHITESPACE)
def detect_whitespace(t):
    return core(consistency.detect_whitespace(t.dirty_customer))


@query(with_view("documents", pattern_cte("documents")) + WIDE)
def detect_non_ascii(t):
    return core(consistency.detect_non_ascii(t.documents))


def case_cte(view: str) -> str:
    return "k as (" + each(
        cols(view, TEXT),
        "select '{c}' as c, lower({c}) as f, count(distinct {c}) as k from v where {c} is not null group by 2",
    ) + "), ks as (select c, sum(k)::bigint as n, sum(case when k > 1 then k end)::bigint as a, count(*) as f from k group by c)"


CASE = issue("inconsistent_case", "c", "a", "100.0 * a / n", "'low'", "from ks where a > 0")


@query(with_view("dirty_customer", case_cte("dirty_customer")) + CASE)
def detect_inconsistent_case(t):
    return core(consistency.detect_inconsistent_case(t.dirty_customer))


@query(
    with_view("dirty_customer", pattern_cte("dirty_customer"), case_cte("dirty_customer"))
    + " union all ".join([MIXED_DATES, MIXED_DECIMALS, CURRENCY, WHITESPACE, WIDE, CASE])
)
def detect_inconsistencies(t):
    return core(consistency.detect_inconsistencies(t.dirty_customer))


def token_cte(table: str, name: str) -> str:
    return (
        f"{name} as (select w, count(*) as k from (select unnest(regexp_split_to_array(lower(text), "
        f"'[^\\p{{L}}\\p{{N}}_]+')) as w from {table}) x where regexp_matches(w, '^[a-z]+$') group by w)"
    )


@query(
    "with " + token_cte("documents", "tok") + ", " + token_cte("benchmark", "dic")
    + ", s as (select sum(k) as n, sum(case when length(w) > 2 and w not in (select w from dic) then k else 0 end) as e from tok)"
    + issue("spelling_errors", "'text'", "e", "100.0 * e / n", ladder("100.0 * e / n", None, 10),
            "from s where 100.0 * e / n > 5")
)
def detect_spelling_errors(t):
    words = spelling.dictionary_from_text(t.benchmark, "text")
    return core(spelling.detect_spelling_errors(t.documents, "text", words))


def column_tokens(table: str, columns: list[str]) -> str:
    return "tok as (" + " union all ".join(
        f"select '{c}' as c, w, count(*) as k from (select unnest(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+')) as w "
        f"from {table}) x where regexp_matches(w, '^[a-z]+$') group by w" for c in columns
    ) + ")"


@query(
    with_view("misdecoded_documents", pattern_cte("misdecoded_documents"), column_tokens("v", ["text", "code"]),
              token_cte("benchmark", "dic"),
              "s as (select c, sum(k) as n, sum(case when length(w) > 2 and w not in (select w from dic) then k else 0 end) as e from tok group by c)",
              "m as (select c, n, marks + case when c = 'code' then wide else 0 end as e from t)")
    + issue("spelling_errors", "c", "e", "100.0 * e / n", ladder("100.0 * e / n", None, 10), "from s where 100.0 * e / n > 5")
    + " union all "
    + issue("encoding_issues", "c", "e", "100.0 * e / n", ladder("e", None, 10), "from m where e > 0")
)
def detect_text_anomalies(t):
    words = spelling.dictionary_from_text(t.benchmark, "text")
    return core(spelling.detect_text_anomalies(t.misdecoded_documents, None, words))


@query(
    with_view("misdecoded_documents", pattern_cte("misdecoded_documents"),
              "e as (select c, n, marks + case when c = 'code' then wide else 0 end as e from t)")
    + issue("encoding_issues", "c", "e", "100.0 * e / n", ladder("e", None, 10), "from e where e > 0")
)
def detect_encoding_issues(t):
    return core(consistency.detect_encoding_issues(t.misdecoded_documents))


def pairs_cte(threshold: float) -> str:
    return (
        "g as (select min(vec_id) as id, count(*) as n, embedding::double[] as e from v group by embedding), "
        "p as (select a.id as id_a, b.id as id_b, a.n as copies_a, b.n as copies_b, "
        "case when a.id = b.id then a.n * (a.n - 1) // 2 else a.n * b.n end as pairs, "
        "case when a.id = b.id then 1.0 else list_cosine_similarity(a.e, b.e) end as similarity "
        "from g a join g b on a.id < b.id or (a.id = b.id and a.n > 1) "
        f"where a.id = b.id or list_cosine_similarity(a.e, b.e) > {threshold})"
    )


@query(
    with_view("near_embeddings", pairs_cte(0.4))
    + "select id_a, id_b, copies_a, copies_b, pairs::bigint as pairs, round(similarity::double, 4) as similarity from p"
)
def similar_pairs(t):
    """A threshold low enough for natural pairs to be found as well."""
    return rounded(similarity.similar_pairs(t.near_embeddings, "vec_id", "embedding", 0.4), "similarity")


@query(
    with_view("near_embeddings", pairs_cte(0.85), "s as (select sum(pairs) as m, (select count(*) from v) as n from p)")
    + issue("semantic_duplicates", "'embedding'", "m", "100.0 * m / n", "case when m > 5 then 'medium' else 'low' end", "from s where m > 0")
)
def detect_semantic_duplicates(t):
    return core(similarity.detect_semantic_duplicates(t.near_embeddings, "vec_id", "embedding"))


@query(
    with_view("near_embeddings", pairs_cte(0.4),
              "nb as (select id, list(id_a) filter (id_a is not null) as smaller from g left join p "
              "on p.id_b = g.id and p.id_a < p.id_b group by id)",
              "led as (select list_reduce(list({'id': [id], 'smaller': coalesce(smaller, []::bigint[])} order by id), "
              "lambda acc, x: {'id': case when list_has_any(acc.id, x.smaller) then acc.id else list_concat(acc.id, x.id) end, "
              "'smaller': acc.smaller}) as l from nb)",
              "leads as (select unnest(l.id) as id from led)",
              "own as (select g.id, coalesce(min(p.id_a) filter (g.id not in (select id from leads)), g.id) as leader "
              "from g left join p on p.id_b = g.id and p.id_a < p.id_b and p.id_a in (select id from leads) group by g.id)",
              "m as (select own.leader, v.vec_id as member from v join g on v.embedding = g.embed join own on own.id = g.id)")
    .replace("embedding::double[] as e from v", "embedding::double[] as e, embedding as embed from v")
    + "select leader, member from m where leader in (select leader from m group by 1 having count(*) > 1)"
)
def cluster_similar(t):
    return similarity.cluster_similar(t.near_embeddings, "vec_id", "embedding", 0.4)


# --- quality analysis --------------------------------------------------------


def auto_cte(view: str) -> str:
    """Counts behind the one-value-at-a-time quality issues."""
    parts = []
    for c in cols(view, ALL):
        if c in cols(view, TEXT):
            v, s = c, strip_sql(c)
            missing_ = f"count(*) filter ({c} is null or {s} in ('', 'nan'))"
        else:
            v = "null::varchar"
            missing_ = f"count(*) - count({c})"
        bad_mail = f"count(*) filter (not regexp_matches({v}, {quote(K.VALID_EMAIL)}))" if "email" in c else "0"
        bad_call = f"count(*) filter (not regexp_matches({v}, {quote(K.VALID_PHONE)}))" if "phone" in c else "0"
        parts.append(
            f"select '{c}' as c, count(*) as n, {missing_} as m, count({v}) as p, "
            f"count(*) filter ({v} like ' %' or {v} like '% ') as sp, {bad_mail} as mail, {bad_call} as call, "
            f"count(*) filter ({v} = '') as em, "
            f"count(*) filter (regexp_matches({v}, {quote(K.NUMERIC_LITERAL)})) as nu from v"
        )
    return "a as (" + " union all ".join(parts) + ")"


def quality_issue(kind, column, rows, whole, severity, deduction, tail):
    p = f"(100.0 * ({rows}) / ({whole}))::double"
    return (
        f"select '{kind}' as issue_type, {column} as \"column\", ({rows})::bigint as affected_rows, "
        f"round({p}, 2) as percentage, {severity.replace('{p}', p)} as severity, "
        f"({deduction.replace('{p}', p)})::double as deduction {tail}"
    )


AUTO = {
    "missing_values": quality_issue("missing_values", "c", "m", "n", ladder("{p}", 30, 10),
                                    "least({p} * 0.5, 25) + least({p} * 0.5, 15)", "from a where m > 0"),
    "duplicates": quality_issue("duplicates", "'all_columns'", "d", "n", ladder("{p}", 10, 5),
                                "least({p} * 0.8, 20)", "from dup where d > 0"),
    "outliers": quality_issue("outliers", "c", "outside", "present", ladder("{p}", None, 5), "least({p} * 0.3, 10)",
                              "from iqr where present > 3 and q3 - q1 > 0 and outside > 0"),
    "whitespace": quality_issue("whitespace", "c", "sp", "p", "'low'", "least({p} * 0.2, 5)", "from a where sp > 0"),
    "case_inconsistency": quality_issue("case_inconsistency", "c", "n - f", "n", "'low'",
                                        "least((n - f) * 0.5, 8)", "from ks where n > f"),
    "invalid_email_format": quality_issue("invalid_email_format", "c", "mail", "p", "'high'", "least({p} * 0.8, 15)",
                                          "from a where mail > 0"),
    "invalid_phone_format": quality_issue("invalid_phone_format", "c", "call", "p", "'medium'", "least({p} * 0.6, 12)",
                                          "from a where call > 0"),
    "empty_strings": quality_issue("empty_strings", "c", "em", "p", "'medium'", "least({p} * 0.4, 10)",
                                   "from a where em > 0"),
    "data_type_mismatch": quality_issue("data_type_mismatch", "c", "nu", "p", "'medium'", "5.0",
                                        "from a where nu > 0.8 * p"),
}


def auto_ctes(view: str) -> list[str]:
    return [auto_cte(view), dup_cte(view), iqr_cte(cols(view, NUM)), case_cte(view)]


def auto_sql(view: str, *kinds: str) -> str:
    body = " union all ".join(AUTO[k] for k in kinds or AUTO)
    return with_view(view, *auto_ctes(view), f"i as ({body})") + (
        'select issue_type, "column", affected_rows, percentage, severity, round(deduction, 4) as deduction from i'
    )


SCORE = (
    "select round(greatest(0, 100 - coalesce(sum(deduction), 0)), 1)::double as quality_score, "
    "round(coalesce(sum(deduction), 0), 2)::double as quality_deductions, count(*) as total_issues, "
    "count(*) filter (severity = 'high') as high_severity, "
    "count(*) filter (severity = 'medium') as medium_severity, "
    "count(*) filter (severity = 'low') as low_severity from i"
)


def score_sql(view: str) -> str:
    body = " union all ".join(AUTO.values())
    return with_view(view, *auto_ctes(view), f"i as ({body})") + SCORE


def scored(issues):
    return rounded(issues.drop("description"), "deduction")


@query(auto_sql("dirty_orders", "missing_values"))
def auto_missing(t):
    return scored(quality.auto_missing(t.dirty_orders))


@query(auto_sql("dirty_orders", "duplicates"))
def auto_duplicates(t):
    return scored(quality.auto_duplicates(t.dirty_orders))


@query(auto_sql("dirty_orders", "outliers"))
def auto_outliers(t):
    return scored(quality.auto_outliers(t.dirty_orders))


@query(auto_sql("dirty_customer", "whitespace"))
def auto_whitespace(t):
    return scored(quality.auto_whitespace(t.dirty_customer))


@query(auto_sql("dirty_customer", "case_inconsistency"))
def auto_case(t):
    return scored(quality.auto_case(t.dirty_customer))


@query(auto_sql("dirty_customer", "invalid_email_format"))
def auto_invalid_email(t):
    return scored(quality.auto_invalid_email(t.dirty_customer))


@query(auto_sql("dirty_customer", "invalid_phone_format"))
def auto_invalid_phone(t):
    return scored(quality.auto_invalid_phone(t.dirty_customer))


@query(auto_sql("dirty_orders", "empty_strings"))
def auto_empty_strings(t):
    return scored(quality.auto_empty_strings(t.dirty_orders))


@query(auto_sql("dirty_customer", "data_type_mismatch"))
def auto_numeric_as_text(t):
    return scored(quality.auto_numeric_as_text(t.dirty_customer))


@query(auto_sql("dirty_customer"))
def quality_analysis(t):
    return scored(quality.analyze_quality(t.dirty_customer))


@query(score_sql("dirty_orders"))
def quality_score(t):
    return quality.quality_score(t.dirty_orders)


@query(score_sql("lineitem"))
def quality_score_lineitem(t):
    return quality.quality_score(t.lineitem)


RECOMMEND = """select issue_type, "column", case
  when issue_type = 'missing_values' and percentage > 70 then 'drop_column'
  when issue_type = 'missing_values' and percentage > 30 then 'advanced_imputation'
  when issue_type = 'missing_values' then 'simple_imputation'
  when issue_type = 'duplicates' then 'drop_duplicates'
  when issue_type = 'outliers' and percentage > 10 then 'cap_outliers'
  when issue_type = 'outliers' then 'remove_outliers'
  when issue_type = 'case_inconsistency' then 'normalize_case'
  when issue_type = 'whitespace' then 'trim_whitespace' end as recommendation
from i where issue_type in ('missing_values', 'duplicates', 'outliers', 'case_inconsistency', 'whitespace')"""


def over_issues(view: str, tail: str) -> str:
    return with_view(view, *auto_ctes(view), f"i as ({' union all '.join(AUTO.values())})") + tail


@query(over_issues("dirty_orders", RECOMMEND))
def recommendations(t):
    return quality.recommendations(quality.analyze_quality(t.dirty_orders))


@query(over_issues("dirty_orders", """select distinct case when issue_type = 'missing_values' then 'Missing Values Detected'
  when issue_type = 'duplicates' then 'Duplicate Rows Found' when issue_type = 'outliers' then 'Statistical Outliers Present'
  else 'Text Quality Issues' end as label from i where issue_type <> 'data_type_mismatch'"""))
def issue_labels(t):
    return quality.issue_labels(quality.analyze_quality(t.dirty_orders))


def _profile_analysis_sql(view):
    missing_ = AUTO["missing_values"].replace("from a ", "from m ")
    outside = AUTO["outliers"].replace("(present)", "(n)").replace("present > 3 and q3 - q1 > 0 and ", "")
    body = " union all ".join([missing_, AUTO["duplicates"], outside])
    return with_view(view, f"m as ({_missing_sql(view)})", dup_cte(view), iqr_cte(cols(view, NUM)), f"i as ({body})") + (
        'select issue_type, "column", affected_rows, percentage, severity, round(deduction, 4) as deduction from i'
    )


@query(_profile_analysis_sql("dirty_orders"))
def profile_to_analysis(t):
    return scored(quality.profile_to_analysis(t.dirty_orders))


@query(over_issues("dirty_customer", "select severity, count(*) as issues from i group by 1"))
def severity_breakdown(t):
    return quality.severity_breakdown(quality.analyze_quality(t.dirty_customer))


@query(
    with_view("dirty_orders", auto_cte("dirty_orders"))
    + 'select c as "column", m as missing, round((100.0 * m / n)::double, 4) as missing_percentage from a where m > 0'
)
def missing_ranking(t):
    return rounded(quality.missing_ranking(t.dirty_orders), "missing_percentage")
