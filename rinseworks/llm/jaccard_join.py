"""Join of documents whose word n-grams overlap, by T-occurrence search.

A document is a set of numbers, one per distinct word n-gram. Two documents link when
their sets have a Jaccard similarity of at least ``percent`` / 100. A partner of a
document with n grams must occur in at least T = ceil(n * percent / 100) of its n inverted
lists. The search sets the T - 1 longest lists aside (DivideSkip): every partner occurs in
one of the remaining, shortest lists, so only these are written out and shuffled. Inside
bounded blocks the same search then merges short lists and probes the long ones.

1. A sketch of hashed counters, summed over all documents, estimates the length of every
   list. It only orders the lists: any order gives the same links.
2. Documents with equal sets become one entry, by a digest of the set.
3. Lists of a few entries are merged: the shuffle counts in how many of them two entries
   meet. With n <= m grams, entries that link must meet in at least
   needed(n, m) - ceil(m * percent / 100) + 1 lists, which drops most chance meetings.
4. Of the other lists each names its smallest entry as pivot. Lists with mostly the same
   members name the same pivot, so the members of a cell (all lists with one pivot) hold
   every pair that meets in such a list. Cells are cut into blocks of bounded size.
5. In each block a bitmap filter leaves out entries that can link with no other: a set hashed
   to bits, at least as many as it has grams, differs from another in at most as many bits as
   the sets differ in grams. Only the sets of the rest travel. Every block is searched with its
   pivot; where a cell has more blocks, only entries that are not yet connected to the pivot
   meet the other blocks, again first by their bitmaps.
6. Links become components; see :mod:`rinseworks.llm.components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.llm.components import components
from rinseworks.llm.learning import summed
from rinseworks.llm.words import pieces, signed, windows, word_numbers

SKETCH_BITS = 22
_CHUNK = 1 << 14
BLOCK = 48
#: Blocks that go together where the rest of a large cell is searched: each set is shipped that
#: many times less often, and a task holds so many blocks of either side.
TOGETHER = 8
SHORT = 8
#: The least bits of a set's bitmap; a set of more grams has the next power of two.
BITS = 2048
#: About the bytes of text that are numbers at a time; each takes some forty of a worker's memory.
PIECE = 1 << 20
BROADCAST_ROWS = 500_000


def gram_sets(texts: pa.Array, size: int, lengths: np.ndarray | None) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text, rarest first if ``lengths`` is given.

    The upper six bits of a number are the class of its list's estimated length.
    """
    numbers, first = word_numbers(texts, lower=True)
    grams = np.zeros(len(numbers), np.uint64)
    grams[: max(0, len(numbers) - size + 1)] = windows(numbers, size)
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size)):
        a, b = first[i], first[i + 1]  # the whole sequence is the only gram
        grams[a] = windows(numbers[a:b], int(b - a), seed=int(b - a))[0]
    if lengths is not None:
        grams = ordered(grams, lengths)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        out.append(np.unique(grams[a : b - size + 1] if b - a >= size else grams[a : min(a + 1, b)]))
    return out


def ordered(grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers whose order is that of the lists' lengths."""
    slot = (grams & np.uint64(len(lengths) - 1)).astype(np.int64)
    return (lengths[slot].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))


def list_lengths(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """The length class (eight to a doubling, from the median) of 2**bits hashed counters."""

    def count(rows: pa.RecordBatch, counters: np.ndarray) -> None:
        numbers, _ = word_numbers(rows.column("text"), lower=True)
        slots = (windows(numbers, size) & np.uint64((1 << bits) - 1)).astype(np.int64)
        np.add.at(counters, slots, 1)

    lengths = summed(docs.select("text"), 1 << bits, count, chunk=_CHUNK, limit=PIECE)
    usual = max(1.0, float(np.median(lengths)))
    return np.clip(np.floor(8 * np.log2(np.maximum(lengths, 1) / usual)), 0, 63).astype(np.uint8)


def set_digest(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else 0


def bitmap(grams: np.ndarray, width: int = BITS) -> bytes:
    """The bits that the numbers of a set fall on; the halves of a wider bitmap, or-ed, are the narrower one."""
    bits = np.zeros(width, bool)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def bits_for(n: int) -> int:
    """The bits of the bitmap of a set of n grams, a power of two."""
    return max(BITS, 1 << max(0, n - 1).bit_length())


def may_link(
    bits: np.ndarray, sizes: np.ndarray, percent: int, first: int | None = None,
    asks: np.ndarray | None = None, roots: np.ndarray | None = None,
) -> np.ndarray:
    """Which sets can link with another one, by their bitmaps (rows of bytes) and sizes.

    Sets that differ in d grams have bitmaps that differ in at most d bits, so a large
    difference bounds the overlap; no set that links is left out. Of two sets at least one is
    among the ``first``; with ``asks`` and ``roots`` the two differ in both.
    """
    words = np.ascontiguousarray(bits).view(np.uint64)
    out = np.zeros(len(words), bool)
    for i, n in enumerate(sizes[:first]):
        near = (100 * sizes >= percent * n) & (percent * sizes <= 100 * n)
        if asks is not None:
            near &= (asks != asks[i]) & (roots != roots[i])
        near[i] = False
        near = np.flatnonzero(near)
        differ = np.bitwise_count(words[near] ^ words[i]).sum(axis=1, dtype=np.int64)
        near = near[sizes[near] + n - differ >= 2 * needed(n, sizes[near], percent)]
        out[near] = True
        out[i] |= len(near) > 0
    return out


def may_link_of(
    bits: list[bytes], sizes: np.ndarray, percent: int,
    asks: np.ndarray | None = None, roots: np.ndarray | None = None,
) -> np.ndarray:
    """``may_link`` of bitmaps of any width: two are compared at the width of the narrower."""
    widths = np.array([len(b) for b in bits], np.int64)
    out = np.zeros(len(bits), bool)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        wider = np.flatnonzero((widths > width) & (percent * sizes <= 100 * sizes[own].max()))
        at = np.concatenate([own, wider])
        rows = np.empty((len(at), width), np.uint8)
        for k, i in enumerate(at):
            rows[k] = np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint8).reshape(-1, width))
        out[at] |= may_link(
            rows, sizes[at], percent, len(own),
            None if asks is None else asks[at], None if roots is None else roots[at],
        )
    return out


def needed(n: int | np.ndarray, m: int | np.ndarray, percent: int):
    """The least overlap of linked sets of n and m grams."""
    return -(-percent * (n + m) // (100 + percent))


def search(queries: list[np.ndarray], index: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the positions of the entries of the index that link with it.

    T-occurrence search over the inverted lists of the index: the longest lists are set
    aside, the short ones are merged, and entries that occur often enough in them are
    looked up in the long ones by binary search.
    """
    sizes = np.array([len(x) for x in index], np.int64)
    grams = np.concatenate(index) if index else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    entries = np.repeat(np.arange(len(index), dtype=np.int32), sizes)[order]
    grams = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(entries))
    places = (np.cumsum(new) - 1) * len(index) + entries  # list and entry in one sorted number
    grams = grams[starts]
    for q, query in enumerate(queries):
        n = len(query)
        if not n or not len(grams):
            continue
        at = np.minimum(np.searchsorted(grams, query), len(grams) - 1)
        at = at[grams[at] == query]
        least = -(-percent * n // 100)
        if len(at) < least:
            continue
        length = ends[at] - starts[at]
        at = at[np.argsort(length, kind="stable")]
        aside = min(least - 1, int(least / (0.1 * np.log2(1 + length.max()) + 1)))
        short, long = at[: len(at) - aside], np.sort(at[len(at) - aside :])
        hits = np.zeros(len(index), np.int64)
        for some in _runs(short, len(index)):
            size = ends[some] - starts[some]
            first = np.repeat(starts[some] - (np.cumsum(size) - size), size)
            hits += np.bincount(entries[first + np.arange(len(first))], minlength=len(index))
        keep = (hits >= max(1, least - aside)) & (100 * sizes >= percent * n) & (percent * sizes <= 100 * n)
        found = np.flatnonzero(keep)
        hits, m = hits[found], sizes[found]
        for some in _runs(long, len(found)) if len(found) else ():
            wanted = (some[:, None] * len(index) + found).ravel()
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            hits = hits + (places[at] == wanted).reshape(len(some), -1).sum(axis=0)
        found = found[hits >= needed(n, m, percent)]
        if len(found):
            yield q, found


def _runs(lists: np.ndarray, members: int) -> Iterator[np.ndarray]:
    """The lists in runs that have at most about ``_CHUNK`` * 64 members together."""
    step = max(1, (_CHUNK << 6) // members)
    for k in range(0, len(lists), step):
        yield lists[k : k + step]


def _spanning(ids: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> pa.Table:
    """Each entry with the first entry of its component, for the found links."""
    parent = np.arange(len(ids))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q, found in links:
        for f in found:
            a, b = top(q), top(int(f))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([top(i) for i in range(len(ids))], np.int64)
    moved = roots != np.arange(len(ids))
    return pa.table({"a": pa.array(ids[roots[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) if x.as_buffer().size else np.zeros(0, np.uint64) for x in column]


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS,
    block: int = BLOCK, short: int = SHORT, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    A null text, an empty one or one without words has no grams and links with nothing.
    A text of fewer than ``size`` words is one gram. Rows that repeat a doc_id are rows
    of their own that share the component of their texts; a null doc_id counts for the
    component but is its smallest only if all are null. An empty table gives no rows.
    Other columns are ignored.
    """
    found = _components(docs.select("doc_id", "text"), [], size, percent, sketch_bits, block, short, broadcast_rows)
    return found.select("doc_id", "n_shingles", "component_id")


def _components(
    docs: DataFrame, keys: list[str], size: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS,
    block: int = BLOCK, short: int = SHORT, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The components with ``keys``, long columns of the rows, the digest ``entry`` of the
    row's set and ``root``, the entry that names its component; null without grams."""
    docs = docs.withColumn("_hash", F.xxhash64("text"))  # with doc_id it finds a row's text again
    lengths = list_lengths(docs, size, sketch_bits)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                sets = gram_sets(part.column("text"), size, lengths)
                n = np.array([len(s) for s in sets], np.int64)
                shortest = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        *(part.column(k) for k in [*keys, "_hash"]),
                        pa.array(n),
                        pa.array([set_digest(s) for s in sets], pa.int64()),
                        pa.array([bitmap(s, bits_for(len(s))) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(
                            np.concatenate([[0], np.cumsum(shortest)]).astype(np.int32),
                            signed(np.concatenate([s[:k] for s, k in zip(sets, shortest)] or [np.zeros(0, np.uint64)])),
                        ),
                    ],
                    ["doc_id", *keys, "_hash", "n_shingles", "entry", "bits", "lists"],
                )

    carried = "".join(f"{k} long, " for k in [*keys, "_hash"])
    marked = durable(docs.mapInArrow(grams, f"doc_id long, {carried}n_shingles long, entry long, bits binary, lists array<long>"))
    postings = marked.select("entry", F.col("n_shingles").alias("n"), F.explode("lists").alias("list"))
    shared = postings.groupBy("list").agg(
        F.min("entry").alias("pivot"), F.max("entry").alias("last"), F.count("*").alias("length")
    )
    shared = durable(shared.where("pivot <> last").select("list", "pivot", "length"))
    met = durable(postings.join(shared.hint("merge"), "list"))  # the same way at every size

    few = met.where(F.col("length") <= short).groupBy("list").agg(
        F.array_sort(F.collect_set(F.struct("entry", "n"))).alias("e")  # at most ``short``
    )
    pairs = few.select(F.explode(F.expr(
        "flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x as x, y as y))))"
    )).alias("pair")).select("pair.*")
    met_often = (
        f"times >= ceil({percent} * (x.n + y.n) / {100 + percent})"
        f" - ceil({percent} * greatest(x.n, y.n) / 100) + 1"
    )
    alike = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = (
        pairs.where(alike).groupBy("x", "y").agg(F.count("*").alias("times")).where(met_often)
        .select(F.col("x.entry").alias("pivot"), F.col("y.entry").alias("entry"))
    )
    cells = met.where((F.col("length") > short) & (F.col("entry") != F.col("pivot"))).select("pivot", "entry")
    cells = durable(cells.union(pairs).distinct())
    per_cell = cells.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    cells = durable(
        cells.join(per_cell, "pivot").withColumn("block", F.expr("pmod(xxhash64(entry, pivot), blocks)"))
    )

    # One row for each entry that is in a cell.
    wanted = durable(cells.select("entry").union(cells.select(F.col("pivot").alias("entry"))).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    wanted = durable(
        marked.join(wanted, "entry", "left_semi").groupBy("entry")
        .agg(F.min(F.struct("doc_id", "_hash", "n_shingles", "bits")).alias("k"))
        .select("entry", F.col("k.doc_id").alias("id"), F.col("k._hash").alias("hash"), "k.n_shingles", "k.bits")
    )

    def filtered(table: pa.Table) -> pa.Table:
        kept = may_link_of(table.column("bits").to_pylist(), table.column("n_shingles").to_numpy(), percent)
        return table.select(["pivot", "block", "entry"]).filter(pa.array(kept, pa.bool_()))

    bitmaps = wanted.select("entry", "n_shingles", "bits")
    placed = cells.select("pivot", "block", "entry").union(
        cells.select("pivot", "block", F.col("pivot").alias("entry")).distinct()
    )
    placed = placed.join(bitmaps, "entry").groupBy("pivot", "block")
    placed = durable(placed.applyInArrow(filtered, "pivot long, block long, entry long"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                sets = gram_sets(part.column("text"), size, lengths)
                right = [set_digest(s) == e for s, e in zip(sets, part.column("entry").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("entry"), pa.array([s.tobytes() for s in sets], pa.binary())], ["entry", "grams"]
                ).filter(pa.array(right, pa.bool_()))

    def sets_of(entries: DataFrame) -> DataFrame:
        chosen = durable(wanted.select("entry", "id", "hash").join(entries.select("entry").distinct(), "entry", "left_semi"))
        small = chosen.count() <= broadcast_rows
        sent = F.broadcast(chosen) if small else chosen
        texts = docs.join(sent, docs.doc_id.eqNullSafe(chosen.id) & (docs["_hash"] == chosen["hash"])).select("entry", "text")
        sets = texts.mapInArrow(to_sets, "entry long, grams binary")
        found = marked.join(sent, marked.doc_id.eqNullSafe(chosen.id) & (marked["_hash"] == chosen["hash"]))
        if found.count() > chosen.count():  # rows equal in doc_id and text all give their set: one of them stays
            sets = sets.dropDuplicates(["entry"])
        return durable(sets)

    sets = sets_of(placed)

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("entry")
        found = _sets(table.column("grams"))
        return _spanning(table.column("entry").to_numpy(), search(found, found, percent))

    placed = F.broadcast(placed) if placed.count() <= broadcast_rows else placed
    links = durable(placed.join(sets, "entry").groupBy("pivot", "block").applyInArrow(within, "a long, b long"))

    # Cells of several blocks: what is not yet connected to the pivot meets the other blocks.
    large = cells.where("blocks > 1")
    if not large.isEmpty():
        roots = components(links, "a", "b")
        known = large.join(roots.withColumnRenamed("node", "entry"), "entry", "left").withColumn(
            "root", F.coalesce("root", "entry")
        )
        heads = large.select("pivot").distinct().join(roots.withColumnRenamed("node", "pivot"), "pivot", "left")
        known = durable(
            known.join(heads.select("pivot", F.coalesce("root", "pivot").alias("head")), "pivot")
        )
        open_ = known.where("root <> head")
        per_cell = open_.groupBy("pivot").agg(F.ceil(F.count("*") / (TOGETHER * block)).alias("parts"))
        asking = open_.join(per_cell, "pivot").select(
            "pivot", F.expr("pmod(xxhash64(pivot, entry), parts)").alias("part"),
            F.explode(F.expr(f"sequence(0L, int((blocks - 1) / {TOGETHER}))")).alias("block"),
            "entry", F.lit(True).alias("asks"), "root",
        )
        answering = known.join(per_cell, "pivot").select(
            "pivot", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"),
            F.expr(f"int(block / {TOGETHER})").cast("long").alias("block"), "entry", F.lit(False).alias("asks"), "root",
        )

        def across(table: pa.Table) -> pa.Table:
            asks = table.column("asks")
            asking, index = table.filter(asks), table.filter(pa.compute.invert(asks))
            a, b, roots_a, roots_b = (
                t.column(c).to_numpy() for c in ("entry", "root") for t in (asking, index)
            )
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for q, found in search(_sets(asking.column("grams")), _sets(index.column("grams")), percent):
                for f in found[roots_b[found] != roots_a[q]]:
                    out[roots_a[q], roots_b[f]] = (a[q], b[f])
            return pa.table({
                "a": pa.array([x for x, _ in out.values()], pa.int64()),
                "b": pa.array([x for _, x in out.values()], pa.int64()),
            })

        def meeting(table: pa.Table) -> pa.Table:
            kept = may_link_of(
                table.column("bits").to_pylist(), table.column("n_shingles").to_numpy(), percent,
                table.column("asks").to_numpy(), table.column("root").to_numpy(),
            )
            return table.drop_columns(["n_shingles", "bits"]).filter(pa.array(kept, pa.bool_()))

        more = asking.unionByName(answering)
        schema = "entry long, pivot long, part long, block long, asks boolean, root long"
        more = more.join(bitmaps, "entry").select("entry", "pivot", "part", "block", "asks", "root", "n_shingles", "bits")
        more = durable(more.groupBy("pivot", "part", "block").applyInArrow(meeting, schema))
        late = more.join(placed.select("entry").distinct(), "entry", "left_anti")  # their sets have not travelled yet
        more = more.join(sets if late.isEmpty() else sets.union(sets_of(late)), "entry")
        more = more.groupBy("pivot", "part", "block").applyInArrow(across, "a long, b long")
        links = links.union(durable(more))

    roots = components(links, "a", "b").withColumnRenamed("node", "entry")
    smallest = marked.where("n_shingles > 0").groupBy("entry").agg(F.min("doc_id").alias("least"))
    named = smallest.join(roots, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("entry", "root", "component_id")
    return marked.select("doc_id", *keys, "n_shingles", "entry").join(named, "entry", "left").select(
        "doc_id", *keys, "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "entry", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"),
    )


def one_per_component(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` with one row for each component, that of the smallest doc_id, a
    null one last, then of the smallest set digest, with all their columns.

    Rows are told apart by doc_id and 128 bits of their text; of rows equal in both one
    stays. So texts that nothing links stay even if they share a doc_id or have none, and
    copies go even without one. Texts without words stay.
    """
    key = ["_a", "_b"]
    keyed = docs.withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64(F.lit(1), "doc_id", "text")})
    found = _components(keyed.select("doc_id", "text", *key), key, broadcast_rows=broadcast_rows, **options)
    found = durable(found.where("n_shingles > 0"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "entry", *key)).alias("k"))
    first = durable(first.select("k._a", "k._b"))
    rows = found.groupBy(*key).count()
    gone = durable(rows.join(first, key, "left_anti").select(*key))
    again = durable(rows.where("count > 1").join(first, key, "left_semi").select(*key))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, key, "left_anti")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= broadcast_rows else again
        twice = kept.join(again, key, "left_semi").dropDuplicates(key)
        kept = kept.join(again, key, "left_anti").unionByName(twice)
    return kept.select(*docs.columns)
