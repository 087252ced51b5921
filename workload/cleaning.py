"""Repair, strategy and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinseworks.frames import small_frame
from rinseworks.operators import duplicates, impute, quality, repair
from rinseworks.plans import auto, engine, model_choice, strategies
from rinseworks.types import ISSUE_SCHEMA, Issue
from workload.catalog import COLUMNS, core, query, rounded, strip_sql, with_view
from workload.profiling import (
    AUTO,
    COLUMN_DUPLICATES,
    CURRENCY,
    MIXED_DATES,
    MIXED_DECIMALS,
    NUM,
    TEXT,
    WHITESPACE,
    WIDE,
    CASE,
    _missing_sql,
    auto_ctes,
    case_cte,
    cols,
    column_duplicate_cte,
    core,
    dup_cte,
    duplicate_issue,
    iqr_cte,
    missing_issue,
    outlier_issue,
    pattern_cte,
)


def fences(column: str, source: str = "v", name: str = "b") -> str:
    q = "quantile_cont({c}::double, {p})"
    q1, q3 = q.format(c=column, p=0.25), q.format(c=column, p=0.75)
    return (
        f"{name} as (select {q1} - 1.5 * ({q3} - {q1}) as lo, {q3} + 1.5 * ({q3} - {q1}) as hi, "
        f"count(*) as n, count({column}) as present from {source})"
    )


# --- dropping ----------------------------------------------------------------


@query(with_view("dirty_orders") + "select * from v where o_totalprice is not null")
def drop_missing_rows(t):
    return repair.drop_missing_rows(t.dirty_orders, "o_totalprice")


@query(
    with_view("gappy_orders")
    + "select * from v where "
    + " + ".join(f"({c} is not null)::int" for c in cols("gappy_orders", 2))
    + " >= 3"
)
def drop_sparse_rows(t):
    return repair.drop_sparse_rows(t.gappy_orders)


@query(with_view("dirty_orders") + "select * exclude (sparse_num) from v")
def drop_sparse_columns(t):
    return repair.drop_sparse_columns(t.dirty_orders)


@query(with_view("dirty_orders") + "select distinct * from v")
def drop_duplicates(t):
    return duplicates.drop_duplicates(t.dirty_orders)


@query(with_view("dirty_orders") + "select * from v group by all having count(*) = 1")
def drop_all_duplicates(t):
    return duplicates.drop_duplicates(t.dirty_orders, keep=False)


# --- imputation --------------------------------------------------------------


@query(
    with_view("dirty_orders")
    + "select o_orderkey, o_custkey, round(coalesce(o_totalprice, (select avg(o_totalprice) from v)), 4) as o_totalprice from v"
)
def impute_mean(t):
    out = impute.impute_mean(t.dirty_orders, "o_totalprice")
    return rounded(out.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice")


@query(
    with_view("dirty_orders")
    + "select o_orderkey, o_custkey, round(coalesce(o_totalprice, (select median(o_totalprice) from v)), 4) as o_totalprice from v"
)
def impute_median(t):
    out = impute.impute_median(t.dirty_orders, "o_totalprice")
    return rounded(out.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice")


def sql_mode(column: str, source: str = "v") -> str:
    return (
        f"(select {column} from {source} where {column} is not null group by {column} "
        f"order by count(*) desc, {column} limit 1)"
    )


@query(
    with_view("dirty_orders")
    + f"select o_orderkey, o_custkey, coalesce(o_orderpriority, {sql_mode('o_orderpriority')}) as o_orderpriority from v"
)
def impute_mode(t):
    out = impute.impute_mode(t.dirty_orders, "o_orderpriority")
    return out.select("o_orderkey", "o_custkey", "o_orderpriority")


@query(
    with_view(
        "dirty_part",
        f"w as (select *, case when {strip_sql('p_type')} <> '' then p_type end as x from v)",
        "g as (select p_container, p_brand, x, row_number() over (partition by p_container, p_brand "
        "order by count(*) desc, x) as r from w where x is not null group by 1, 2, 3)",
    )
    + f"select p_partkey, w.p_container, w.p_brand, coalesce(w.x, g.x, {sql_mode('x', 'w')}) as p_type from w "
    "left join g on r = 1 and g.p_container is not distinct from w.p_container "
    "and g.p_brand is not distinct from w.p_brand"
)
def impute_context_mode(t):
    out = impute.impute_context_mode(t.dirty_part, "p_type")
    return out.select("p_partkey", "p_container", "p_brand", "p_type")


def parent_mode_cte(target: str, parent: str, source: str, name: str = "g") -> str:
    return (
        f"{name} as (select {parent} as pk, {target} as x, row_number() over (partition by {parent} "
        f"order by count(*) desc, {target}) as r from {source} where {target} is not null "
        f"and {parent} is not null group by 1, 2)"
    )


@query(
    with_view("dirty_part", parent_mode_cte("p_type", "p_brand", "v"),
              "f as (select v.* replace (coalesce(p_type, g.x) as p_type) from v left join g on r = 1 and pk = p_brand)")
    + f"select p_partkey, p_brand, coalesce(p_type, {sql_mode('p_type', 'f')}) as p_type from f"
)
def impute_parent_mode(t):
    out, _ = impute.impute_parent_mode(t.dirty_part, "p_type")
    return out.select("p_partkey", "p_brand", "p_type")


@query(
    with_view(
        "dirty_customer",
        "take as (select c_custkey as k, c_nationkey as a from v where c_acctbal is null)",
        "give as (select c_custkey as k, c_nationkey as a, c_acctbal as x from v where c_acctbal is not null)",
        "near as (select take.k, give.x, row_number() over (partition by take.k order by "
        "sqrt(((take.k - give.k) * (take.k - give.k) + (take.a - give.a) * (take.a - give.a)) * (3 / 2.0)), give.k) as r "
        "from take, give)",
        "f as (select k, avg(x) as x from near where r <= 5 group by k)",
    )
    + "select c_custkey, c_nationkey, round(coalesce(c_acctbal, f.x), 4) as c_acctbal from v left join f on f.k = c_custkey"
)
def impute_knn(t):
    out = impute.impute_knn(t.dirty_customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    return rounded(out, "c_acctbal")


@query()
def impute_iterative(t):
    rows = t.gappy_lineitem.drop("l_returnflag")
    return rounded(impute.impute_iterative(rows), "l_quantity", "l_extendedprice", digits=2)


# --- outliers ----------------------------------------------------------------


@query(with_view("events", fences("value")) + "select event_id, value from v, b where value between lo and hi")
def remove_outliers_iqr(t):
    return repair.remove_outliers_iqr(t.events.select("event_id", "value"), "value")


@query(
    with_view("dirty_orders", "b as (select quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from v)")
    + "select o_orderkey, round(case when o_totalprice is not null then least(greatest(o_totalprice, lo), hi) end, 4) as o_totalprice from v, b"
)
def cap_outliers_percentile(t):
    out = repair.cap_outliers_percentile(t.dirty_orders, "o_totalprice")
    return rounded(out.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(
    with_view("dirty_orders", fences("o_totalprice"))
    + "select o_orderkey, round(case when o_totalprice is not null then least(greatest(o_totalprice, lo), hi) end, 4) as o_totalprice from v, b"
)
def cap_outliers_iqr(t):
    out = repair.cap_outliers_iqr(t.dirty_orders, "o_totalprice")
    return rounded(out.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(
    with_view("dirty_customer", "b as (select min(c_acctbal) as m from v)")
    + "select c_custkey, round(case when m <= 0 then ln(1 + (c_acctbal - m + 1)) else ln(1 + c_acctbal) end, 4) as c_acctbal from v, b"
)
def log_transform(t):
    out = repair.log_transform(t.dirty_customer, "c_acctbal")
    return rounded(out.select("c_custkey", "c_acctbal"), "c_acctbal")


def adaptive_ctes(columns: list[str], source: str, rows: str = "*") -> tuple[list[str], str]:
    """One step per numeric column; the last name holds the result."""
    ctes, now = [], source
    for i, c in enumerate(columns):
        b, nxt = f"fence{i}", f"step{i}"
        ctes.append(fences(c, now, f"{b}_q"))
        ctes.append(
            f"{b} as (select *, case when present <= 10 then 0 else 100.0 * "
            f"(select count(*) from {now} where {c} < lo or {c} > hi) / n end as share from {b}_q)"
        )
        ctes.append(
            f"{nxt} as (select {now}.* replace (case when share > 10 and {c} is not null "
            f"then least(greatest({c}, lo), hi) else {c} end as {c}) from {now}, {b} "
            f"where share <= 0 or share > 5 or {c} between lo and hi)"
        )
        now = nxt
    if "sparse_num" in columns:
        columns = [*columns[:2], "sparse_num"]
    else:
        columns = columns[:2]
    whole = ", ".join(f"cast({c} as bigint) as {c}" for c in columns)  # none of them is capped
    ctes.append(f"adapted as (select * replace ({whole}) from {now})")
    return ctes, "adapted"


ADAPTIVE, ADAPTED = adaptive_ctes(cols("dirty_orders", NUM), "v")


@query(with_view("dirty_orders", *ADAPTIVE) + f"select * from {ADAPTED}")
def adaptive_outliers(t):
    out, _ = repair.adaptive_outliers(t.dirty_orders)
    return out


# --- text --------------------------------------------------------------------


@query(
    with_view("dirty_customer")
    + "select c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as titled, "
    "lower(c_mktsegment) as lowered, upper(c_mktsegment) as uppered from v where c_mktsegment not like ' %' or c_mktsegment is null"
    " union all select c_custkey, ' ' || upper(substr(c_mktsegment, 2, 1)) || lower(substr(c_mktsegment, 3)), "
    "lower(c_mktsegment), upper(c_mktsegment) from v where c_mktsegment like ' %'"
)
def convert_case(t):
    df = t.dirty_customer
    out = df.withColumns(
        {"titled": F.col("c_mktsegment"), "lowered": F.col("c_mktsegment"), "uppered": F.col("c_mktsegment")}
    )
    for column, style in (("titled", "title_case"), ("lowered", "lowercase"), ("uppered", "uppercase")):
        out = repair.convert_case(out, column, style)
    return out.select("c_custkey", "titled", "lowered", "uppered")


@query(with_view("dirty_customer") + f"select c_custkey, {strip_sql('c_mktsegment')} as c_mktsegment from v")
def strip_whitespace(t):
    return repair.strip_whitespace(t.dirty_customer, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query(
    with_view("dirty_customer")
    + "select c_custkey, upper(substr(s, 1, 1)) || lower(substr(s, 2)) as c_mktsegment, email, phone, balance_text, date_text "
    f"from (select *, {strip_sql('c_mktsegment')} as s from v) x"
)
def normalize_text_columns(t):
    out = repair.normalize_text_columns(t.dirty_customer)
    return out.select("c_custkey", *COLUMNS["dirty_customer"][TEXT])


# --- strategies and pipelines ------------------------------------------------

SELECT = """select issue_type, "column", affected_rows, case
  when issue_type = 'missing_values' then case when 100.0 * affected_rows / (select count(*) from v) > 70 then 'drop_rows'
    when "column" in ({numbers}) then 'median_imputation' else 'categorical_context_imputation' end
  when issue_type = 'exact_duplicates' then 'drop_duplicates' when issue_type = 'numeric_outliers' then 'cap_outliers'
  when issue_type = 'inconsistent_case' then 'lowercase' when issue_type = 'leading_trailing_whitespace' then 'strip_whitespace'
  else 'no_action' end as strategy from i"""


FOUND = 'select issue_type, "column", affected_rows, percentage, severity from i'


def engine_issues(view: str, repeated: list[str], result: str = SELECT) -> str:
    parts = [missing_issue(), duplicate_issue(), COLUMN_DUPLICATES, outlier_issue(), MIXED_DATES,
             MIXED_DECIMALS, CURRENCY, WHITESPACE, WIDE, CASE]
    numbers = ", ".join(f"'{c}'" for c in cols(view, NUM))
    return with_view(
        view, f"m as ({_missing_sql(view)})", dup_cte(view), column_duplicate_cte(repeated),
        iqr_cte(cols(view, NUM)), pattern_cte(view), case_cte(view), f"i as ({' union all '.join(parts)})",
    ) + result.replace("{numbers}", numbers)


@query(engine_issues("dirty_customer", ["c_custkey", "c_nationkey", *cols("dirty_customer", TEXT)], FOUND))
def detect_issues(t):
    """Everything the detectors find, as the engine sees it."""
    return core(engine.detect_issues(t.dirty_customer))


@query(engine_issues("dirty_orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "sparse_num"]))
def select_strategy(t):
    df = t.dirty_orders
    chosen = strategies.select_strategy(engine.detect_issues(df), df)
    return chosen.select("issue_type", "column", "affected_rows", "strategy")


@query()
def select_by_model(t):
    df = t.dirty_customer.select("c_custkey", "c_nationkey", "c_acctbal")
    missing = df.where(F.col("c_acctbal").isNull()).count()
    issue = Issue("missing_values", "c_acctbal", missing, 0.0, "low", "")
    _, table = model_choice.select_by_model(df, issue, "classification")
    return rounded(table, "score")


ENGINE = [
    "a1 as (select v.* replace (coalesce(o_totalprice, (select median(o_totalprice) from v)) as o_totalprice) from v)",
    "w as (select *, case when trim(o_orderpriority) <> '' then o_orderpriority end as x from a1)",
    "g as (select o_orderstatus as pk, x, row_number() over (partition by o_orderstatus order by count(*) desc, x) as r "
    "from w where x is not null group by 1, 2)",
    f"a2 as (select w.* exclude (x) replace (coalesce(w.x, g.x, {sql_mode('x', 'w')}) as o_orderpriority) "
    "from w left join g on r = 1 and pk is not distinct from o_orderstatus)",
    "a3 as (select * from a2 where sparse_num is not null)",
    "a4 as (select distinct * from a3)",
    "b as (select quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from a4)",
    "a5 as (select a4.* replace (least(greatest(o_totalprice, lo), hi) as o_totalprice, lower(o_orderstatus) as o_orderstatus) from a4, b)",
]


@query(
    with_view("dirty_orders", *ENGINE)
    + "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice, o_orderpriority, sparse_num from a5"
)
def engine_clean(t):
    out, _ = engine.engine_clean(t.dirty_orders)
    return rounded(out, "o_totalprice")


@query()
def engine_actions(t):
    df = t.dirty_customer
    _, report = engine.engine_clean(df)
    return engine.actions_frame(df.sparkSession, report)


AUTO_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
AUTO_ADAPTIVE, AUTO_ADAPTED = adaptive_ctes(AUTO_COLUMNS, "c3")
AUTO_STEPS = [
    "c1 as (select * exclude (sparse_num) replace (coalesce(o_totalprice, (select median(o_totalprice) from v)) as o_totalprice) from v)",
    parent_mode_cte("o_orderpriority", "o_orderstatus", "c1", "ag"),
    "c2 as (select c1.* replace (coalesce(o_orderpriority, ag.x) as o_orderpriority) from c1 left join ag on r = 1 and pk = o_orderstatus)",
    f"c3 as (select distinct * from (select c2.* replace (coalesce(o_orderpriority, {sql_mode('o_orderpriority', 'c2')}) as o_orderpriority) from c2) x)",
    *AUTO_ADAPTIVE,
    f"c4 as (select * replace (upper({strip_sql('o_orderstatus')}) as o_orderstatus, {strip_sql('o_orderpriority')} as o_orderpriority) from {AUTO_ADAPTED})",
]


@query(
    with_view("dirty_orders", *AUTO_STEPS)
    + "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice, o_orderpriority from c4"
)
def auto_clean(t):
    out, _ = auto.auto_clean(t.dirty_orders)
    return rounded(out, "o_totalprice")


def _after_sql() -> str:
    """Quality issues of the repaired orders: every CTE of the analysis over c4 under its own name."""
    parts = [x.replace("from v", "from c4") for x in _after_parts()]
    return ", ".join(parts)


def _after_parts():
    from workload.profiling import auto_cte

    view = "dirty_orders"
    saved = COLUMNS[view]
    COLUMNS[view] = (AUTO_COLUMNS, saved[1], [c for c in saved[2] if c != "sparse_num"])
    try:
        return [auto_cte(view), dup_cte(view), iqr_cte(AUTO_COLUMNS), case_cte(view)]
    finally:
        COLUMNS[view] = saved


def _comparison_sql() -> str:
    issues = " union all ".join(AUTO.values())
    score = "greatest(0, 100 - coalesce(sum(deduction), 0))"
    before = f"(with {', '.join(auto_ctes('dirty_orders'))}, i as ({issues}) select round({score}, 1)::double as s, count(*) as k from i)"
    after = f"(with {_after_sql()}, i as ({issues}) select round({score}, 1)::double as s, count(*) as k from i)"
    return with_view(
        "dirty_orders", *AUTO_STEPS, f"bef as {before}", f"aft as {after}",
        "nb as (select count(*) as n from v)", "na as (select count(*) as n from c4)",
    ) + (
        "select bef.s as before_score, aft.s as after_score, round(aft.s - bef.s, 4) as improvement, "
        "nb.n as rows_before, na.n as rows_after, nb.n - na.n as rows_removed, 6::bigint as columns_before, "
        "5::bigint as columns_after, bef.k as issues_before, aft.k as issues_after, "
        "round(100.0 * (bef.k - aft.k) / bef.k, 4)::double as success_percentage, "
        "case when aft.s >= 95 then 'excellent' when aft.s >= 85 then 'good' when aft.s >= 70 then 'fair' "
        "else 'needs attention' end as band from bef, aft, nb, na"
    )


@query(_comparison_sql())
def quality_comparison(t):
    before = t.dirty_orders
    after, _ = auto.auto_clean(before)
    return rounded(quality.quality_comparison(before, after), "improvement", "success_percentage")


def _metrics_sql() -> str:
    view = "dirty_orders"
    nulls = lambda s, cs: "(select " + " + ".join(f"sum(({c} is null)::int)" for c in cs) + f" from {s})"
    after = [dup_cte(view).replace("from v", "from c4").replace(", sparse_num", ""),
             iqr_cte(AUTO_COLUMNS, "iqr", "c4")]
    return with_view(
        view, *AUTO_STEPS,
        f"bef as (with {dup_cte(view)}, {iqr_cte(cols(view, NUM))} select {nulls('v', cols(view, 2))} as m, (select d from dup) as d, (select sum(outside) from iqr) as o)",
        f"aft as (with {', '.join(after)} select {nulls('c4', [c for c in cols(view, 2) if c != 'sparse_num'])} as m, (select d from dup) as d, (select sum(outside) from iqr) as o)",
    ) + (
        "select (bef.m - aft.m)::bigint as missing_values_fixed, (bef.d - aft.d)::bigint as duplicates_removed, "
        "(bef.o - aft.o)::bigint as outliers_handled from bef, aft"
    )


@query(_metrics_sql())
def report_metrics(t):
    before = t.dirty_orders
    after, _ = auto.auto_clean(before)
    return engine.report_metrics(before, after)
