"""Text, page, word-box, similarity and audit queries, and the file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rinseworks.frames import durable, shared_folder, small_frame
from rinseworks.functions import constants as K
from rinseworks.functions.expr import words
from rinseworks.operators import audit, boxes, delimited, html, repair, sections, spelling
from rinseworks.plans import engine, strategies
from rinseworks.sources import inventory, readers, writers
from rinseworks.types import ISSUE_FIELDS, Issue
from workload.catalog import COLUMNS, core, query, quote, rounded, strip_sql, with_view
from workload.cleaning import FOUND, engine_issues
from workload.profiling import token_cte

SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.WHITESPACE) + "]+"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda x: x <> '')"


def pieces(text: str, separator: str) -> str:
    return (
        f"list_filter(list_transform(string_split({text}, {separator}), lambda x: {strip_sql('x')}), lambda x: x <> '')"
    )


SECTIONS = (
    f"arrays as (select doc_id, text, {pieces('text', 'concat(chr(10), chr(10))')} as para, {pieces('text', 'chr(10)')} as lines from v)",
    "sized as (select *, greatest(5, len(lines) // 10) as k from arrays)",
    "split as (select doc_id, case when len(para) >= 2 then para when len(lines) > 10 then "
    "list_transform(range(0, len(lines), k), lambda i: array_to_string(lines[i + 1 : i + k], chr(10))) else lines end as s from sized)",
    "sections as (select doc_id, unnest(s) as text, generate_subscripts(s, 1) as section from split)",
)


def hits(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)})"


def patterns_sql(text: str = "text") -> str:
    out = []
    names = {"email": "emails", "phone": "phones", "date": "dates", "number": "numbers", "url": "urls", "currency": "currency"}
    for kind, pattern in sections.PATTERNS.items():
        found = hits(text, pattern)
        out.append(f"nullif(len({found}), 0)::bigint as {names[kind]}_found")
        if kind != "number":
            out.append(f"{found}[1] as first_{kind}")
    return ", ".join(out)


@query(with_view("dirty_documents", *SECTIONS) + "select doc_id, section::bigint as section, text from sections")
def split_sections(t):
    return sections.split_sections(t.dirty_documents.select("doc_id", "text"), "text")


@query(
    with_view(
        "dirty_documents",
        f"arrays as (select doc_id, text, {pieces('text', 'repeat(chr(10), 3)')} as gaps, {sql_words('text')} as ws from v)",
        "sized as (select *, greatest(100, len(ws) // 5) as k from arrays)",
        f"split as (select doc_id, case when contains(text, chr(12)) then list_filter(string_split(text, chr(12)), lambda x: {strip_sql('x')} <> '') "
        "when len(gaps) <> 1 then gaps else list_transform(range(0, len(ws), k), lambda i: array_to_string(ws[i + 1 : i + k], ' ')) end as s from sized)",
    )
    + "select doc_id, generate_subscripts(s, 1)::bigint as page, unnest(s) as text from split"
)
def split_pages(t):
    return sections.split_pages(t.dirty_documents.select("doc_id", "text"), "text")


@query(
    with_view("dirty_documents", *SECTIONS)
    + f"select doc_id, section::bigint as section, text, len({sql_words('text')})::bigint as word_count, "
    f"length(text)::bigint as char_count, {patterns_sql()} from sections"
)
def section_stats(t):
    return sections.section_stats(t.dirty_documents.select("doc_id", "text"), "text")


@query(with_view("dirty_documents") + f"select doc_id, {patterns_sql()} from v")
def extract_patterns(t):
    return sections.extract_patterns(t.dirty_documents.select("doc_id", "text"), "text").drop("text")


def _matches(kind: str):
    found = hits("text", sections.PATTERNS[kind])

    @query(
        with_view("dirty_documents", f"m as (select doc_id, {found} as f from v)")
        + "select doc_id, generate_subscripts(f, 1)::bigint as position, unnest(f) as match from m"
    )
    def run(t):
        return sections.extract_matches(t.dirty_documents, "doc_id", "text", kind)

    return run


def _register_matches():
    from workload.catalog import QUERIES, SQL

    names = {"email": "extract_emails", "phone": "extract_phones", "date": "extract_dates",
             "number": "extract_numbers", "url": "extract_urls", "currency": "extract_currency"}
    for kind, name in names.items():
        _matches(kind)
        QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_register_matches()

STATISTICS = (
    f"len(list_filter(string_split(text, '.'), lambda x: {strip_sql('x')} <> ''))::bigint as sentence_count, "
    f"coalesce(round(list_sum(list_transform({sql_words('text')}, lambda x: length(x)))::double / nullif(len({sql_words('text')}), 0), 2), 0) as avg_word_length"
)


@query(with_view("dirty_documents") + f"select doc_id, {STATISTICS} from v")
def text_statistics(t):
    return sections.text_statistics(t.dirty_documents.select("doc_id", "text"), "text").drop("text")


@query(
    with_view("dirty_documents")
    + f"select doc_id, lang, md5(text) as digest, {patterns_sql()}, {STATISTICS} from v where {strip_sql('text')} <> ''"
)
def text_to_tabular(t):
    out = sections.text_to_tabular(t.dirty_documents.select("doc_id", "lang", "text"), "text")
    return out.withColumn("digest", F.md5("text")).drop("text")


# --- web pages ---------------------------------------------------------------


@query()
def html_elements(t):
    return html.html_elements(t.pages, "page_id", "html").withColumn("data", F.to_json("data"))


BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g')"
HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(
    f"select page_id, {HOST} as host, len(regexp_extract_all(b, '(?i)<h[1-6][\\s>]'))::bigint as headings, "
    f"len(regexp_extract_all(b, '(?i)<a\\s[^>]*href'))::bigint as links from (select *, {BARE} as b from pages) x"
)
def html_link_stats(t):
    return html.html_link_stats(t.pages, "page_id", "url", "html")


@query(
    f"select {HOST} as host, count(*) as pages, sum(len(regexp_extract_all(b, '(?i)<h[1-6][\\s>]')))::bigint as headings, "
    f"sum(len(regexp_extract_all(b, '(?i)<a\\s[^>]*href')))::bigint as links from (select *, {BARE} as b from pages) x group by 1"
)
def html_host_stats(t):
    return html.html_host_stats(t.pages, "page_id", "url", "html")


def _links_sql() -> str:
    found = "regexp_extract_all(b, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', {n})"
    return (
        f"select page_id, unnest({found.replace('{n}', '1')}) as url, unnest({found.replace('{n}', '2')}) as text "
        f"from (select *, {BARE} as b from pages) x"
    )


@query(_links_sql())
def html_links(t):
    """The links among the elements."""
    found = html.html_elements(t.pages, "page_id", "html")
    return found.where(F.col("type") == "link").select("page_id", "url", "text")


@query(
    with_view("order_pages")
    + "select page_id, 0::bigint as table_id, 0::bigint as row_id, cast(page_id as varchar) as order_cell, o_orderstatus as status_cell, "
    "null::varchar as single from v join orders on page_id = o_orderkey "
    "union all select page_id, 0, 1, null, null, o_orderpriority from v join orders on page_id = o_orderkey"
)
def html_table_rows(t):
    rows = html.html_table_rows(t.order_pages, "page_id", "html")
    return rows.select(
        "page_id", "table_id", "row_id",
        F.try_element_at("data", F.lit("Order")).alias("order_cell"),
        F.try_element_at("data", F.lit("Status")).alias("status_cell"),
        F.try_element_at("data", F.lit("col_0")).alias("single"),
    )


def _visible_sql() -> str:
    bare = f"regexp_replace(regexp_replace({BARE}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    lines = f"list_transform(string_split(b, chr(10)), lambda x: {strip_sql('x')})"
    parts = f"flatten(list_transform({lines}, lambda x: list_transform(string_split(x, '  '), lambda y: {strip_sql('y')})))"
    return (
        f"select page_id, array_to_string(list_filter({parts}, lambda x: x <> ''), ' ') as text "
        f"from (select page_id, {bare} as b from pages) x"
    )


@query(_visible_sql())
def html_visible_text(t):
    return html.html_visible_text(t.pages, "page_id", "html")


# --- delimited texts and word boxes ------------------------------------------


@query(
    with_view("delimited_customers")
    + "select v.c_custkey, case v.c_custkey % 4 when 0 then chr(9) when 1 then ',' when 2 then '|' else ';' end as delimiter, "
    "3::bigint as columns, 1::bigint as rows, c_name as name, c_mktsegment as segment, "
    "case when v.c_custkey % 5 <> 0 then concat('n', cast(c_nationkey as varchar)) end as note "
    "from v join customer c on c.c_custkey = v.c_custkey"
)
def sniff_delimited(t):
    found = delimited.sniff_delimited(t.delimited_customers, "c_custkey", "text")
    rows = delimited.delimited_rows(found, "c_custkey")
    return found.select("c_custkey", "delimiter", "columns", "rows").join(
        rows.select(
            "c_custkey",
            F.col("data")["name"].alias("name"),
            F.col("data")["segment"].alias("segment"),
            F.col("data")["note"].alias("note"),
        ),
        "c_custkey",
    )


@query(
    with_view(
        "word_boxes",
        "b as (select *, sum(case when conf > 30 and trim(txt) <> '' then 0 else 1 end) over "
        "(partition by doc_id order by line_num, word_num) as run from v)",
    )
    + "select doc_id, run::bigint as block, string_agg(txt, ' ' order by line_num, word_num) as text, "
    "round(avg(conf)::double, 4) as confidence, count(*) as word_count from b where conf > 30 and trim(txt) <> '' group by 1, 2"
)
def word_boxes_to_blocks(t):
    return rounded(boxes.word_boxes_to_blocks(t.word_boxes, "doc_id", "line_num", "word_num"), "confidence")


WORD_CELLS = (
    "good as (select * from v where conf > 35 and doc_id in (select doc_id from v where conf > 35 group by 1 having count(*) >= 8))",
    "head as (select doc_id, txt as name, x_left as lo, x_left + width as hi from good where line_num = 0)",
    "near as (select g.doc_id, g.line_num, g.word_num, g.txt, g.x_left, h.name, row_number() over "
    "(partition by g.doc_id, g.line_num, g.word_num order by greatest(h.lo - (g.x_left + g.width / 2), (g.x_left + g.width / 2) - h.hi, 0), h.lo) as r "
    "from good g join head h on g.doc_id = h.doc_id where g.line_num > 0)",
)


@query(
    with_view("word_boxes", *WORD_CELLS)
    + "select doc_id, 1 as block_num, 1 as par_num, line_num, name as \"column\", string_agg(txt, ' ' order by x_left) as value "
    "from near where r = 1 group by 1, 4, 5"
)
def word_boxes_to_table(t):
    return boxes.word_boxes_to_table(t.word_boxes, "doc_id")


ROLE_COLUMNS = ["ref", "who", "amount", "total", "day", "paid", "kind", "thing"]
TESTS = {
    "Order ID": f"regexp_matches(x, {quote(K.ORDER_ID)})",
    "Customer ID": f"regexp_matches(x, {quote(K.CUSTOMER_ID)})",
    "Order Date": "regexp_matches(x, '^(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}/\\d{1,2}/\\d{4})$')",
    "Payment Method": "regexp_matches(lower(x), 'credit|cash|wallet|card')",
    "Quantity": "coalesce(try_cast(x as double) = floor(try_cast(x as double)) and try_cast(x as double) >= 0 and try_cast(x as double) < 200, false)",
    "Price": "try_cast(x as double) is not null",
    "Order Total": "try_cast(x as double) is not null",
    "Category": "regexp_matches(lower(x), 'dishes|dessert|drink|starter|main|side')",
}
TESTS["Item"] = "not (" + " or ".join(TESTS[r] for r in ("Order ID", "Customer ID", "Order Date", "Payment Method", "Price")) + ")"


@query(
    with_view("order_strings", "s as (" + " union all ".join(f"select '{c}' as c, trim({c}) as x from v" for c in ROLE_COLUMNS) + ")")
    + " union all ".join(
        f"select c as \"column\", '{role}' as role, round(avg(({test})::int)::double, 4) as share from s group by c"
        for role, test in TESTS.items()
    )
)
def role_shares(t):
    return rounded(boxes.role_shares(t.order_strings.select(*ROLE_COLUMNS)), "share")


def _roles_sql() -> str:
    """The greedy choice, one step per role over the columns still free."""
    ctes, taken = [], []
    for i, role in enumerate(K.ROLE_ORDER):
        free = "".join(f" and c not in (select c from r{j})" for j in taken)
        ctes.append(
            f"r{i} as (select c from (select c, pos, avg(({TESTS[role]})::int) as share from s where true{free} "
            f"group by c, pos order by share desc, pos limit 1) b where share >= 0.5)"
        )
        taken.append(i)
    source = "s as (" + " union all ".join(
        f"select '{c}' as c, {i} as pos, trim({c}) as x from v" for i, c in enumerate(ROLE_COLUMNS)
    ) + ")"
    return with_view("order_strings", source, *ctes) + " union all ".join(
        f"select '{role}' as role, c as \"column\" from r{i}" for i, role in enumerate(K.ROLE_ORDER)
    )


@query(_roles_sql())
def infer_column_roles(t):
    roles = boxes.infer_column_roles(t.order_strings.select(*ROLE_COLUMNS))
    return small_frame(t.spark, list(roles.items()), "role string, column string")


@query(
    with_view("order_strings")
    + "select o_orderkey, ref as \"Order ID\", who as \"Customer ID\", kind as \"Category\", "
    "case when amount = 'fry' then thing || ' fry' else thing end as \"Item\", "
    "try_cast(regexp_extract(total, '[-+]?[0-9]*\\.?[0-9]+') as double) as \"Price\", try_cast(amount as double) as \"Quantity\", "
    "null::double as \"Order Total\", case when contains(day, '/') then substr(day, 7, 4) || '-' || substr(day, 1, 2) || '-' || substr(day, 4, 2) else day end as \"Order Date\", "
    "case when contains(lower(paid), 'wallet') then 'Digital Wallet' when contains(lower(paid), 'cash') then 'Cash' else 'Credit Card' end as \"Payment Method\" from v"
)
def normalize_order_table(t):
    roles = {"Order ID": "ref", "Customer ID": "who", "Order Date": "day", "Payment Method": "paid",
             "Quantity": "amount", "Price": "total", "Category": "kind", "Item": "thing"}
    out = boxes.normalize_order_table(t.order_strings, roles, keep=("o_orderkey",))
    return out.withColumn("Order Date", F.date_format("Order Date", "yyyy-MM-dd"))


def _pages_sql() -> str:
    """Cells of every page, empty ones too, the greedy choice of roles by page, and the pivot."""
    steps = []
    for i, role in enumerate(K.ROLE_ORDER):
        free = "".join(f" and not exists (select 1 from r{j} where r{j}.doc_id = s.doc_id and r{j}.c = s.c)" for j in range(i))
        steps.append(
            f"r{i} as (select doc_id, c, '{role}' as role from (select doc_id, c, share, row_number() over "
            f"(partition by doc_id order by share desc, pos) as k from (select doc_id, c, pos, avg(({TESTS[role]})::int) as share "
            f"from s where true{free} group by 1, 2, 3)) where k = 1 and share >= 0.5)"
        )
    value = {role: f"coalesce(max(case when role = '{role}' then x end), '')" for role in K.ORDER_COLUMNS}
    paid = value["Payment Method"]
    columns = ", ".join(
        [f"nullif({value[r]}, '') as \"{r}\"" for r in ("Order ID", "Customer ID", "Category", "Item")]
        + [f"try_cast(regexp_extract({value[r]}, '[-+]?[0-9]*\\.?[0-9]+') as double) as \"{r}\"" for r in ("Price", "Quantity", "Order Total")]
        + [f"nullif({value['Order Date']}, '') as \"Order Date\"", f"nullif({paid}, '') as \"Payment Method\""]
    )
    cells = WORD_CELLS + (
        "vals as (select doc_id, line_num, name, string_agg(txt, ' ' order by x_left) as x from near where r = 1 group by 1, 2, 3)",
        "s as (select l.doc_id, l.line_num, h.name as c, h.lo as pos, coalesce(vals.x, '') as x from "
        "(select distinct doc_id, line_num from vals) l join head h on h.doc_id = l.doc_id left join vals on "
        "vals.doc_id = l.doc_id and vals.line_num = l.line_num and vals.name = h.name)",
    )
    roles = "roles as (" + " union all ".join(f"select * from r{i}" for i in range(len(K.ROLE_ORDER))) + ")"
    return with_view("word_boxes", *cells, *steps, roles) + (
        f"select * from (select s.doc_id, 1 as block_num, 1 as par_num, line_num, {columns} from s join roles "
        "on roles.doc_id = s.doc_id and roles.c = s.c group by 1, 2, 3, 4) where \"Order ID\" is not null or \"Item\" is not null"
    )


@query(_pages_sql())
def page_order_tables(t):
    out = boxes.page_order_tables(t.word_boxes, "doc_id")
    return out.withColumn("Order Date", F.date_format("Order Date", "yyyy-MM-dd"))


# --- spelling ----------------------------------------------------------------

FORMS = (
    "list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), "
    "lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))))"
)
CORRECTIONS = (
    token_cte("documents", "tok"),
    token_cte("benchmark", "dic"),
    f"lf as (select w, unnest({FORMS.replace('{w}', 'w')}) as f from tok where length(w) > 2 and w not in (select w from dic))",
    f"rf as (select w as term, k, unnest({FORMS.replace('{w}', 'w')}) as f from dic)",
    "cand as (select distinct lf.w, term, k from lf join rf on lf.f = rf.f)",
    "fix as (select w, term, row_number() over (partition by w order by k desc, term) as r from cand where damerau_levenshtein(w, term) <= 1)",
)


@query("with " + ", ".join(CORRECTIONS) + " select w as word, term as correction from fix where r = 1")
def spelling_corrections(t):
    terms = spelling.dictionary_from_text(t.benchmark, "text")
    return spelling.spelling_corrections(t.documents, "text", terms)


@query(
    "with " + ", ".join(CORRECTIONS)
    + ", parts as (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') as p from documents), "
    "piece as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from parts) "
    "select doc_id, md5(string_agg(coalesce(term, x), '' order by i)) as digest from piece "
    "left join fix on r = 1 and w = lower(x) group by doc_id"
)
def correct_spelling(t):
    terms = spelling.dictionary_from_text(t.benchmark, "text")
    out = spelling.correct_spelling(t.documents, "doc_id", "text", terms)
    return out.select("doc_id", F.md5("text").alias("digest"))


# --- audit -------------------------------------------------------------------


def redact_sql(text: str) -> str:
    for pattern in K.SENSITIVE.values():
        text = f"regexp_replace({text}, {quote(pattern)}, '{K.REDACTED}', 'gi')"
    return text


@query(with_view("dirty_documents") + f"select doc_id, md5({redact_sql('text')}) as digest, length({redact_sql('text')})::bigint as chars from v")
def redact_sensitive(t):
    out = audit.redact_sensitive(t.dirty_documents, "text")
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query(f"select conv_id, turn, role, {redact_sql('text')} as text from conversations")
def redact_conversations(t):
    return audit.redact_sensitive(t.conversations, "text")


@query(
    with_view("dirty_documents", *[
        f"h{i} as (select '{n}' as pattern, len(regexp_extract_all(text, {quote('(?i)' + p)})) as h from v)"
        for i, (n, p) in enumerate(K.SENSITIVE.items())
    ])
    + " union all ".join(
        f"select pattern, sum(h)::bigint as matches, count(*) filter (h > 0) as rows from h{i} group by 1"
        for i in range(len(K.SENSITIVE))
    )
)
def sensitive_counts(t):
    return audit.sensitive_counts(t.dirty_documents, "text")


@query(
    "select json_object('timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'level', case when event_type = 'error' then 'ERROR' else 'INFO' end, "
    "'message', event_type, 'user_id', user_id)::varchar as entry from events where event_type <> 'view' union all "
    "select json_object('timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'level', 'INFO', 'message', event_type)::varchar from events where event_type = 'view'"
)
def structured_events(t):
    """Events as JSON lines; views carry no user, which leaves the field out."""
    kind = F.col("event_type")
    return audit.structured_events(
        t.events,
        timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        level=F.when(kind == "error", "ERROR").otherwise("INFO"),
        message=kind,
        user_id=F.when(kind != "view", F.col("user_id")),
    )


@query(
    "select upper(event_type) as action, concat('event:', cast(event_id as varchar)) as resource, user_id, "
    "concat('{\"kind\":\"', event_type, '\"}') as details, concat('AUDIT: ', upper(event_type), ' on event:', cast(event_id as varchar)) as message from events"
)
def audit_trail(t):
    return audit.audit_trail(
        t.events,
        F.upper("event_type"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")),
        F.col("user_id"),
        F.struct(F.col("event_type").alias("kind")),
    )


@query("select event_type as action, user_id, count(*) as events, min(ts) as first_seen, max(ts) as last_seen from events group by 1, 2")
def audit_rollup(t):
    return audit.audit_rollup(t.events, "event_type", "user_id", "ts")


@query("select * from events order by ts desc, event_id limit 50")
def recent_sessions(t):
    return audit.recent(t.events, "ts", "event_id", 50)


@query("select * from events where event_id = 77")
def lookup_by_id(t):
    return audit.lookup_by_id(t.events, "event_id", 77)


# --- files -------------------------------------------------------------------


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query(
    with_view("dirty_customer")
    + "select c_custkey, c_nationkey, c_acctbal, nullif(c_mktsegment, '') as c_mktsegment, email, "
    "case when phone = 'n/a' then null else phone end as phone, balance_text, date_text from v"
)
def read_csv_permissive(t):
    """Customers written as delimited text and read back; ``n/a`` comes back as missing."""
    folder = _folder(t)
    df = t.dirty_customer
    writers.write_cleaned(df, folder, "csv")
    return readers.read_csv_permissive(t.spark, folder, df.schema)


@query(
    with_view("dirty_customer")
    + "select c_custkey, c_mktsegment, " + ", ".join(f"{strip_sql(c)} as {c}" for c in ("email", "phone", "balance_text")) + " from v"
)
def write_cleaned(t):
    """Customers with stripped text, written in each format and read back as one of them."""
    df = t.dirty_customer.select("c_custkey", "c_mktsegment", "email", "phone", "balance_text")
    for c in ("email", "phone", "balance_text"):
        df = repair.strip_whitespace(df, c)
    df = durable(df)
    back = []
    for kind in ("json", "parquet"):
        folder = _folder(t)
        writers.write_cleaned(df, folder, kind)
        back.append(readers.read_json(t.spark, folder, df.schema) if kind == "json" else t.spark.read.parquet(folder))
    return back[0].intersectAll(back[1])


@query(
    "select s_suppkey, abs(s_acctbal) as s_acctbal, n as affected_rows, case when n > 0 then 'take_magnitude' else 'no_action' end as strategy "
    "from supplier, (select count(*) as n from supplier where s_acctbal < 0) x"
)
def registered_repair(t):
    """A detector and a strategy of the caller's own, registered, found, chosen and applied."""
    df = t.supplier.select("s_suppkey", "s_acctbal")

    def negative(frame):
        below = F.count_if(F.col("s_acctbal") < 0)
        return frame.agg(below.alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0").select(
            F.lit("negative_balance").alias("issue_type"), F.lit("s_acctbal").alias("column"), F.col("n").alias("affected_rows"),
            (100.0 * F.col("n") / F.col("rows")).alias("percentage"), F.lit("low").alias("severity"), F.lit("below zero").alias("description"),
        )

    strategies.register_detector("negative_balance", negative)
    strategies.register_strategy("negative_balance", "take_magnitude", lambda frame, issue, _: frame.withColumn(issue.column, F.abs(issue.column)))
    try:
        found = engine.detect_issues(df).where("issue_type = 'negative_balance'")
        out, affected, name = df, 0, strategies.NO_ACTION.name
        for row in strategies.select_strategy(found, df).collect():  # one issue at most
            issue = Issue(**{k: row[k] for k in ISSUE_FIELDS})
            chosen = next(s for s in strategies.candidates(issue.issue_type) if s.name == row["strategy"])
            out, affected, name = strategies.apply_strategy(out, issue, chosen), issue.affected_rows, chosen.name
        return out.select("*", F.lit(affected).cast("bigint").alias("affected_rows"), F.lit(name).alias("strategy"))
    finally:
        strategies.unregister("negative_balance")
        strategies.unregister("take_magnitude")


@query(with_view("dirty_customer") + "select * from v")
def read_json(t):
    folder = _folder(t)
    df = t.dirty_customer
    writers.write_cleaned(df, folder, "json")
    return readers.read_json(t.spark, folder, df.schema)


@query(
    f"select {strip_sql('x')} as text from (select unnest(string_split(replace(text, chr(13), ' '), chr(10))) as x from documents) y"
)
def read_text_lines(t):
    folder = _folder(t)
    t.documents.select(F.translate("text", "\r", " ").alias("value")).write.text(folder)
    return readers.read_text_lines(t.spark, folder)


@query()
def file_inventory(t):
    found = inventory.file_inventory(t.spark, t.folder)
    return found.select("name", "extension", "kind", "size", "accepted")


def _sql_of(name: str) -> str:
    from workload.catalog import SQL

    return SQL[name]


@query(_sql_of("dataset_stats"))
def write_profile(t):
    """The table part of a written profile, read back."""
    folder = _folder(t)
    writers.write_profile(t.dirty_orders, folder)
    names = ["total_rows", "total_columns", "missing_values", "duplicates", "numeric_columns", "text_columns"]
    return t.spark.read.schema(", ".join(f"{n} bigint" for n in names)).json(f"{folder}/table")


@query(_sql_of("column_profile"))
def write_profile_columns(t):
    """The columns part of a written profile, read back."""
    folder = _folder(t)
    writers.write_profile(t.lineitem, folder)
    kinds = "position int, column string, data_type string, unique_values bigint, null_count bigint, null_percentage double, minimum double, maximum double, mean double, std double"
    return rounded(t.spark.read.schema(kinds).json(f"{folder}/columns"), "null_percentage", "mean", "std")


@query(engine_issues("dirty_orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "sparse_num"], FOUND))
def write_report_issues(t):
    """The issues of a written cleaning report, read back."""
    folder = _folder(t)
    _, report = engine.engine_clean(t.dirty_orders)
    writers.write_report(t.spark, report, folder)
    return core(t.spark.read.schema(
        "issue_type string, column string, affected_rows bigint, percentage double, severity string, description string"
    ).json(f"{folder}/issues"))


@query()
def write_report(t):
    """The actions of a written cleaning report, read back."""
    folder = _folder(t)
    _, report = engine.engine_clean(t.dirty_orders)
    writers.write_report(t.spark, report, folder)
    return t.spark.read.schema(
        "step bigint, issue_type string, column string, strategy string, rows_affected bigint, success boolean"
    ).json(f"{folder}/actions")
