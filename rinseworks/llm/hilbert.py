"""Shards cut from a Hilbert curve over document metadata.

Source, language and size are quantised to a few bits each; the position of a document's
cell on the Hilbert curve through that cube is its sort key. Neighbours on the curve are
neighbours in every dimension, so runs of the sorted documents make files with narrow
ranges in all of them, which readers skip by file statistics. Everything is DataFrame and
SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable

BITS = 5
SHARDS = 40


def hashed_level(value: Column, bits: int = BITS) -> Column:
    """A level for a name; names have no order, so equal names only need to stay together."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int").bitwiseAND(
        (1 << bits) - 1
    )


def size_level(size: Column, bits: int = BITS) -> Column:
    """A level for each factor of about 1.41 in size, from 16 bytes on."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(2 * F.log2(size)) - 8)).cast("int")


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The position on the Hilbert curve of a cell with the given level in each dimension.

    Folds the levels by the curve's rotations and reflections, from the highest bit down,
    turns them into Gray code and interleaves their bits.
    """
    n = len(levels)
    steps = ", ".join(f"struct({1 << b} as q, {i} as i)" for b in range(bits - 1, 0, -1) for i in range(n))
    masks = ", ".join(str(1 << b) for b in range(bits - 1, 0, -1))
    folded = f"""aggregate(array({steps}), levels, (a, s) -> transform(a, (v, k) -> v ^ case
        when (a[s.i] & s.q) > 0 then if(k = 0, s.q - 1, 0)
        when k = 0 or k = s.i then (a[0] ^ a[s.i]) & (s.q - 1)
        else 0 end))"""
    gray = f"transform({folded}, (v, k) -> aggregate(slice({folded}, 1, k + 1), 0, (x, y) -> x ^ y))"
    turned = f"transform(g, v -> v ^ aggregate(array({masks}), 0, (t, q) -> if((g[{n - 1}] & q) > 0, t ^ (q - 1), t)))"
    woven = " + ".join(
        f"(shiftright(x[{i}], {b}) & 1) * {1 << (b * n + n - 1 - i)}L" for b in range(bits) for i in range(n)
    )
    # ``transform`` over an array of one element names an intermediate result.
    text = f"transform(transform(array({gray}), g -> {turned}), x -> {woven})[0]".replace(
        "levels", "array(" + ", ".join(f"int({c})" for c in ("_level_%d" % i for i in range(n))) + ")"
    )
    return F.expr(text)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot`` of every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text and 16 more. The shards' row counts differ by
    one at most; the slot counts from 0 within a shard. Documents of one cell are ordered by
    the checksum of their text, so copies are neighbours, and then by doc_id. A null text
    is empty, a null source or language is the empty name, a null doc_id comes first;
    repeated rows take slots of their own. Missing rows make empty shards. Other columns
    are ignored.

    The rank comes from a range-partitioned sort: each row knows its partition and its
    place there, and the partitions' counts, one row each, give the offsets.
    """
    return _sharded(docs, shards, bits, []).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def _sharded(docs: DataFrame, shards: int, bits: int, carry: list[str]) -> DataFrame:
    """The shards with the columns ``carry`` of the row in the struct ``row``."""
    row = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("row")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        hashed_level(F.col("source"), bits).alias("_level_0"), hashed_level(F.col("lang"), bits).alias("_level_1"),
        size_level(size, bits).alias("_level_2"), row,
    )
    rows = rows.select(
        "doc_id", "size", "text_crc32", hilbert_index([F.col(f"_level_{i}") for i in range(3)], bits).alias("curve"), "row"
    )
    key = ["curve", "text_crc32", "doc_id", "size"]
    placed = durable(
        rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.expr("sum(n) over (order by part) - n").alias("before"), F.expr("sum(n) over ()").alias("total"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank)
    shard = F.expr(f"rank * {shards} div total")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", "row", F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Write the documents as one folder of Parquet files for each shard, in slot order.

    Every row is written once, with its own columns and ``curve``, ``shard`` and ``slot``, which
    replace columns of these names. Rows go to ranges of (shard, slot), so no task holds more
    than its range, whatever the shards' sizes.
    """
    kept = [c for c in docs.columns if c not in ("curve", "shard", "slot")]
    placed = _sharded(docs, shards, bits, kept).select(*(F.col("row")[c].alias(c) for c in kept), "curve", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shards_sql(shards: int = SHARDS, bits: int = BITS) -> str:
    """The same in DuckDB SQL: one step of the folding for each nested query."""
    level = f"(('0x' || substr(md5(coalesce({{}}, '')), 1, 4))::int & {(1 << bits) - 1})"
    inner = f"""select doc_id, size, text_crc32, {level.format('source')} as x0, {level.format('lang')} as x1,
        least({(1 << bits) - 1}, greatest(0, floor(2 * log2(size))::int - 8)) as x2 from (
        select doc_id, source, lang, coalesce(octet_length(encode(text)), 0) + 16 as size, {crc32_sql('text')} as text_crc32 from documents)"""
    for b in range(bits - 1, 0, -1):
        for i in range(3):
            q, names = 1 << b, ["x0", "x1", "x2"]
            new = {n: n for n in names}
            new["x0"] = f"case when x{i} & {q} > 0 then xor(x0, {q - 1}) else xor(x0, xor(x0, x{i}) & {q - 1}) end"
            if i:
                new[f"x{i}"] = f"case when x{i} & {q} > 0 then x{i} else xor(x{i}, xor(x0, x{i}) & {q - 1}) end"
            inner = f"select doc_id, size, text_crc32, " + ", ".join(f"{new[n]} as {n}" for n in names) + f" from ({inner})"
    inner = f"select doc_id, size, text_crc32, x0, xor(x0, x1) as x1, xor(xor(x0, x1), x2) as x2 from ({inner})"
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, case when x2 & {1 << b} > 0 then {(1 << b) - 1} else 0 end)"
    inner = f"select doc_id, size, text_crc32, xor(x0, t) as x0, xor(x1, t) as x1, xor(x2, t) as x2 from (select *, {turn} as t from ({inner}))"
    woven = " + ".join(f"((x{i} >> {b}) & 1)::bigint * {1 << (b * 3 + 2 - i)}" for b in range(bits) for i in range(3))
    return f"""select doc_id, size, text_crc32, 'rows' as law, shard::int as shard,
        rank - (shard * total + {shards - 1}) // {shards} as slot, null::int as grown_shard from (
        select *, rank * {shards} // total as shard from (
        select doc_id, size, text_crc32, count(*) over () as total, row_number() over (
            order by curve, text_crc32, doc_id nulls first, size) - 1 as rank
        from (select doc_id, size, text_crc32, {woven} as curve from ({inner}))))"""


def crc32_sql(column: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB SQL, byte by byte with a computed table."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    codes = f"list_transform(regexp_extract_all(hex(encode(coalesce({column}, ''))), '..'), lambda h: ('0x' || h)::bigint)"
    return f"""xor(list_reduce({codes}, lambda c, b: xor(c >> 8, ({table}::bigint[])[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"""
