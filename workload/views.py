"""Whole tables with planted defects, in SQL that Spark and DuckDB read alike.

The given tables are clean, so each view spoils cells of every row of a table by rule.
``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinseworks.frames import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# long texts: the work per row outweighs dealing out the rows of a small file
HEAVY = {"documents", "pages"}

VIEWS = {
    "dirty_orders": """
select o_orderkey, o_custkey,
  case when o_orderkey % 5 = 0 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 500 = 1 then o_totalprice * 100 else o_totalprice end as o_totalprice,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 97 = 0 then '' else o_orderpriority end as o_orderpriority,
  case when o_orderkey % 4 = 0 then o_custkey else null end as sparse_num
from (select * from {orders} union all select * from {orders} where o_orderkey % 100 = 0) t""",
    "gappy_orders": """
select case when o_orderkey % 50 = 0 then null else o_orderkey end as o_orderkey,
  case when o_orderkey % 50 = 0 then null else o_custkey end as o_custkey,
  case when o_orderkey % 50 = 0 then null else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 3 = 0 or o_orderkey % 50 = 0 then null else o_totalprice end as o_totalprice,
  case when o_orderkey % 7 = 0 then null else o_orderpriority end as o_orderpriority,
  cast(null as double) as empty_num
from {orders}""",
    "dirty_customer": """
select c_custkey, c_nationkey,
  case when c_custkey % 17 = 0 then null else c_acctbal end as c_acctbal,
  case when c_custkey % 7 = 0 then concat(' ', c_mktsegment, ' ') when c_custkey % 9 = 0 then lower(c_mktsegment)
       when c_custkey % 31 = 0 then null else c_mktsegment end as c_mktsegment,
  case when c_custkey % 17 = 3 then concat('user', cast(c_custkey as varchar(20)))
       else concat('user', cast(c_custkey as varchar(20)), '@example.com') end as email,
  case when c_custkey % 19 = 0 then 'n/a' else concat('555-', lpad(cast(c_custkey % 1000 as varchar(20)), 3, '0'),
       '-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) end as phone,
  case when c_custkey % 23 = 0 then concat('$', cast(c_custkey as varchar(20)), '.50')
       when c_custkey % 29 = 0 then concat(cast(c_custkey as varchar(20)), ',50')
       else concat(cast(c_custkey as varchar(20)), '.50') end as balance_text,
  case when c_custkey % 3 = 0 then concat('0', cast(1 + c_custkey % 9 as varchar(20)), '/15/2024')
       else concat('2024-0', cast(1 + c_custkey % 9 as varchar(20)), '-15') end as date_text
from {customer}""",
    "dirty_part": """
select p_partkey, p_name, p_brand,
  case when p_partkey % 13 = 0 then null else concat('BOX', cast(p_size % 5 as varchar(20))) end as p_container,
  case when p_partkey % 7 = 0 then null when p_partkey % 11 = 0 then ' ' else p_type end as p_type,
  p_retailprice
from {part}""",
    "gappy_lineitem": """
select l_orderkey, l_linenumber, l_returnflag,
  case when (l_orderkey + l_linenumber) % 10 = 0 then null else l_quantity end as l_quantity,
  case when (l_orderkey + l_linenumber) % 15 = 1 then null else l_extendedprice end as l_extendedprice,
  l_discount, l_tax
from {lineitem}""",
    "dirty_documents": """
select doc_id, lang, source, concat(case when doc_id % 10 = 0 then ' ' else '' end,
  case when doc_id % 4 = 0 then replace(text, '. ', concat('.', chr(10), chr(10))) else text end,
  case when doc_id % 6 = 0 then ' Mail: a.b@example.com, call 555-123-4567 on 2024-01-15, $1,250.00, see https://example.com/x password=abc123' else '' end) as text
from {documents}""",
    "misdecoded_documents": """
select doc_id, case when doc_id % 3 = 0 then replace(text, 'é', 'Ã©') else text end as text, lang as code
from {documents}""",
    "delimited_customers": """
select c_custkey, concat('name', d, 'segment', d, 'note', chr(10), c_name, d, c_mktsegment,
  case when c_custkey % 5 = 0 then '' else concat(d, 'n', cast(c_nationkey as varchar(20))) end, chr(10), d, d, chr(10),
  case when c_custkey % 3 = 0 then concat('a', d, 'b', d, 'c', d, 'd') else '' end) as text
from (select *, case when c_custkey % 4 = 0 then chr(9) when c_custkey % 4 = 1 then ',' when c_custkey % 4 = 2 then '|' else ';' end as d
      from {customer}) t""",
    "order_pages": """
select o_orderkey as page_id, concat('<html><body><table><tr><th>Order</th><th>Status</th></tr><tr><td>',
  cast(o_orderkey as varchar(20)), '</td><td>', o_orderstatus, '</td></tr><tr><td>', o_orderpriority,
  '</td></tr></table></body></html>') as html
from {orders}""",
    "order_strings": """
select o_orderkey, concat('ORD-', cast(o_orderkey as varchar(20))) as ref,
  concat('CUST_', cast(o_custkey as varchar(20))) as who,
  case when o_orderkey % 40 = 0 then 'fry' else cast(1 + o_orderkey % 9 as varchar(20)) end as amount,
  concat(case when o_orderkey % 4 = 0 then 'Rs ' else '' end, cast(1000 + o_custkey as varchar(20)), '.5') as total,
  case when o_orderkey % 3 = 0 then concat('0', cast(1 + o_orderkey % 9 as varchar(20)), '/15/2024')
       else concat('2024-0', cast(1 + o_orderkey % 9 as varchar(20)), '-15') end as day,
  case when o_orderkey % 4 = 0 then 'CASH' when o_orderkey % 4 = 1 then 'credit' when o_orderkey % 4 = 2 then 'e-wallet' else 'Debit card' end as paid,
  case when o_orderstatus = 'F' then 'Main dishes' else 'Dessert' end as kind,
  concat(o_orderpriority, ' parcel') as thing
from {orders}""",
    "near_embeddings": """
select vec_id, embedding, label from {embeddings}
union all select vec_id + 1000000 as vec_id, embedding, label from {embeddings} where vec_id % 25 = 0""",
}

# word boxes: every order is a page of four lines of three words
WORD_BOXES = """
select o_orderkey as doc_id, line_num, word_num, 1 as block_num, 1 as par_num,
  word_num * 150 as {left}, line_num * 20 as {top}, 60 as width, 12 as height,
  case when line_num = 0 then concat('Head', cast(word_num as varchar(20)))
       when word_num = 0 then concat('ORD-', cast(o_orderkey as varchar(20)))
       else cast(o_custkey + word_num as varchar(20)) end as {text},
  case when line_num > 0 and (o_custkey + line_num * 3 + word_num) % 10 = 0 then 20 else 90 end as conf
from (select *, {word} as word_num from (select *, {line} as line_num from {orders}) l) w"""

SPARK_BOXES = {
    "left": "`left`", "top": "top", "text": "text",
    "line": "explode(sequence(0, 3))", "word": "explode(sequence(0, 2))",
}
SQL_BOXES = {
    "left": "x_left", "top": "y_top", "text": "txt",
    "line": "unnest([0, 1, 2, 3])", "word": "unnest([0, 1, 2])",
}


class Data:
    """Tables and views of one data folder as frames, read on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(frame) if name in HEAVY else frame
        if name == "word_boxes":
            return self._sql(WORD_BOXES, SPARK_BOXES)
        if name in VIEWS:
            return self._sql(VIEWS[name])
        raise AttributeError(name)

    def _sql(self, body: str, words: dict[str, str] | None = None) -> DataFrame:
        for word, value in (words or {}).items():
            body = body.replace("{" + word + "}", value)
        used = [t for t in TABLES if "{" + t + "}" in body]
        return self.spark.sql(body, **{t: getattr(self, t) for t in used})


def sql_view(name: str) -> str:
    """The view's text for DuckDB."""
    text = WORD_BOXES if name == "word_boxes" else VIEWS[name]
    for word, value in SQL_BOXES.items():
        text = text.replace("{" + word + "}", value)
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text
