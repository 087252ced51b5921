"""Repair of conversations whose turns are missing, empty, repeated, cut off or mislabelled.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows may be
kept, given the role user or assistant, deleted, or empty rows inserted; the cheapest such
edits are found by iterative-deepening A*, depth first in ASCII order of the edits, so the
first accepting path is the least of the cheapest.

1. Rows are sorted by range (a long conversation spans several tasks) and get their place.
   Only keys and SHA-256 digests are sorted; the texts stay where they are.
2. Rows become letters (initial of the role and fault), and up to ``SEGMENT`` neighbouring
   rows of a conversation a segment. What a path costs depends on the rows before a segment
   only by the state (nothing yet, after s, u or a) in which it is entered. So segments are
   searched apart: for the costs between all states, from which a pass from each
   conversation's last segment to its first gives what remains after each segment; then for
   the edits from each state with that remainder; a pass forwards picks the states entered.
3. The edits join the texts by digest in a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable

SEGMENT = 32
SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row of an initial, and the only other role that may come next.
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserts that end a conversation after its last row, by state.
CLOSING = (0, 2, 1, 0)
NEVER = 1 << 60


def letter(initial: Column, fault: Column) -> Column:
    """One ASCII letter for an initial (0-2 of ``sua``, 3 else) and a fault (0 none, 1 truncated, 2 to delete)."""
    return F.char(F.lit(97) + initial + 4 * fault)


def search(codes: str, exits: tuple[int, ...], entry: int, low: list[int]) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest path over the rows ``codes`` from ``entry``.

    ``exits`` is what remains to be paid in each state after the rows. ``low`` holds for row
    and state (four to a row) a bound below the cost from there; a state that fails within
    what is left of the bound raises it, so that it is not searched again with as little.
    """
    n = len(codes)
    path: list[str] = []

    def go(i: int, q: int, left: int) -> int:
        if i == n:
            return q if exits[q] <= left else -1
        at = 4 * i + q
        if low[at] > left:
            return -1
        fault, initial = divmod(ord(codes[i]) - 97, 4)
        extra = TRUNCATED if fault == 1 else 0
        least = NEVER
        steps = [("D", DELETE, i + 1, q), ("I", INSERT, i, NEXT[q])]
        if fault < 2:
            if (q, initial) in KEEP:
                steps.append(("K", extra, i + 1, KEEP[q, initial]))
            steps.append(("R", REROLE + extra, i + 1, NEXT[q]))
        for name, cost, j, p in steps:
            if cost + low[4 * j + p] <= left:
                path.append(name)
                end = go(j, p, left - cost)
                if end >= 0:
                    return end
                path.pop()
            least = min(least, cost + low[4 * j + p])
        low[at] = max(low[at], least)
        return -1

    # A state that can be reached is reached for no more than this.
    most = DELETE * n + 2 * INSERT + TRUNCATED + max((x for x in exits if x < NEVER), default=0)
    while (bound := low[entry]) <= most:
        end = go(0, entry, bound)
        if end >= 0:
            return bound, "".join(path), end
    return NEVER, "", -1


def bounds(codes: str, exits: tuple[int, ...]) -> list[int]:
    """The first lower bounds: every row with a fault costs at least its deletion."""
    rest, out = min(exits), []
    for c in reversed(codes):
        rest += DELETE if c >= "e" else 0
        out.append(rest)
    return [x for x in reversed(out) for _ in range(4)] + list(exits)


@lru_cache(1 << 15)
def paths(codes: str, exits: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """:func:`search` from each of the four states."""
    low = bounds(codes, exits)
    return [search(codes, exits, q, low) for q in range(4)]


@lru_cache(1 << 15)
def between(codes: str) -> list[int]:
    """The costs from each state (four to a row) to each state over the rows."""
    out = [NEVER] * 16
    for end in range(4):
        exits = tuple(0 if q == end else NEVER for q in range(4))
        low = bounds(codes, exits)
        for q in range(4):
            kept_system = q == START and any(c in "ae" for c in codes)
            if end in (USER, ASSISTANT) or q == end or (end == SYSTEM and kept_system):
                out[4 * q + end] = search(codes, exits, q, low)[0]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, times`` with planted faults, by the checksum of ``conv_id:turn``.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it (``times`` 2) and 4 makes its role user. A null in any column counts as a space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("times"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows in order, written: ``conv_id, turn, role, digest, place, initial, fault, kind``.

    ``place`` grows along a conversation: by turn, nulls first, then role, then digest.
    """
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(last == "", "blank").when(~F.substring(last, -1, 1).isin(*".!?"), "truncated")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    key = ["conv_id", "turn", "role", "digest"]
    keys = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"),
        fault.alias("fault"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"),
    ).withColumn("salt", F.monotonically_increasing_id())
    placed = durable(
        keys.repartitionByRange(*key, "salt").sortWithinPartitions(*key, "salt")
        .select(*key, "initial", "fault", F.monotonically_increasing_id().alias("place"))
    )
    seen = (
        placed.where("fault is null or fault = 'truncated'").groupBy("conv_id", "role", "digest")
        .agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when((F.col("place") > F.col("first")) & ~F.col("fault").eqNullSafe("blank"), "duplicate").otherwise(F.col("fault"))
    return durable(placed.join(seen, same, "left").select(*key, "place", "initial", fault.alias("fault")))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _added(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch


_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())


def cheapest_edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each segment of :func:`faults`' rows, written: ``conv_id, seg, audit, cost, illegal, edits``.

    ``edits`` lists what remains of it: the row's place (null for inserts at the end), its
    new role or null, and the initials of the roles inserted before it.
    """
    fault = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    line = F.array_sort(F.collect_list(F.struct("place", letter(F.col("initial"), fault).alias("letter"))))
    segments = rows.groupBy("conv_id", F.floor(F.col("place") / segment).alias("seg")).agg(line.alias("line"))
    segments = durable(segments.select(
        "conv_id", "seg", F.array_join("line.letter", "").alias("codes"), F.col("line.place").alias("places"),
        F.expr("lag(seg) over (partition by conv_id order by seg) is not null").alias("later"),
    ))
    base = "conv_id long, seg long, codes string, places array<long>"

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [between(c) if later else [] for c, later in _columns(batch, "codes", "later")]
            yield _added(batch.drop_columns(["later"]), costs=pa.array(found, _LONGS))

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = None, ()
        for batch in batches:
            exits = []
            for conv, cost in _columns(batch, "conv_id", "costs"):
                if now != (conv,):
                    now, after = (conv,), tuple(INSERT * k for k in CLOSING)
                exits.append(after)
                if cost:
                    after = tuple(min(min(cost[4 * q + p] + after[p], NEVER) for p in range(4)) for q in range(4))
            yield _added(batch.drop_columns(["costs"]), exits=pa.array(exits, _LONGS))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [paths(c, tuple(x)) for c, x in _columns(batch, "codes", "exits")]
            yield _added(
                batch.drop_columns(["exits"]), audits=pa.array([[a for _, a, _ in f] for f in found], _TEXTS),
                ends=pa.array([[e for _, _, e in f] for f in found], _LONGS),
                totals=pa.array([[c for c, _, _ in f] for f in found], _LONGS),
            )

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, before, held, out = None, START, 3, None, []
        schema = pa.schema([
            ("conv_id", pa.int64()), ("seg", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
            ("edits", pa.list_(pa.struct([("place", pa.int64()), ("role", pa.string()), ("before", pa.string())]))),
        ])

        def closed(row: list) -> list:
            if CLOSING[state]:
                row[2] += "I" * CLOSING[state]
                row[5].append((None, None, "ua"[-CLOSING[state] :]))
            return row

        for batch in batches:
            for conv, seg, codes, places, audits, ends, totals in _columns(
                batch, "conv_id", "seg", "codes", "places", "audits", "ends", "totals"
            ):
                illegal, cost = 0, 0
                if now != (conv,):
                    if held:
                        out.append(closed(held))
                    now, state, cost, before = (conv,), START, totals[START], None
                elif held:
                    out.append(held)
                for c in codes:
                    initial = (ord(c) - 97) % 4
                    illegal += before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1))
                    before = initial
                held = [conv, seg, audits[state], cost, illegal, kept(codes, places, audits[state], state)]
                state = ends[state]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)
            out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(held), schema.types)], schema=schema)

    # A conversation's segments pass through one task twice as a few numbers each; the searches are spread.
    known = segments.mapInArrow(costs, base + ", costs array<long>")
    known = known.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(
        backwards, base + ", exits array<long>"
    )
    known = known.repartition("conv_id", "seg").mapInArrow(solve, base + ", audits array<string>, ends array<long>, totals array<long>")
    return durable(known.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        forwards, "conv_id long, seg long, audit string, cost long, illegal long,"
        " edits array<struct<place:long, role:string, before:string>>",
    ))


def kept(codes: str, places: list[int], audit: str, state: int) -> list[tuple]:
    """What an audit leaves of a segment's rows: place, new role or null, initials inserted before."""
    out, i, before = [], 0, ""
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            before += ROLES[state][0]
            continue
        if edit != "D":
            role = None
            if edit == "K":
                state = KEEP[state, (ord(codes[i]) - 97) % 4]
            else:
                state = NEXT[state]
                role = ROLES[state]
            out.append((places[i], role, before))
            before = ""
        i += 1
    return out  # an insert is never followed by a deletion: the other order is the lesser


def repaired(rows: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows after repair, ``conv_id, turn, role, text, edit``, conversations whole and in order.

    An undeleted row is the first with its role and text, so its digest finds its text.
    Inserted rows have a null turn. Each conversation streams through one task, in batches.
    """
    edit = edits.select("conv_id", F.explode("edits").alias("edit")).select("conv_id", "edit.*")
    key = ["conv_id", "tail", "turn", "role", "digest", "is_text"]
    new = [F.col("new"), F.col("before"), F.lit("").alias("text")]
    on_rows = edit.where("place is not null").select("place", F.col("role").alias("new"), "before").join(placed, "place")
    on_rows = on_rows.select(
        "conv_id", F.lit(False).alias("tail"), "turn", "role", "digest", F.lit(False).alias("is_text"), *new
    )
    tails = edit.where("place is null").select(
        "conv_id", F.lit(True).alias("tail"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.lit(False).alias("is_text"), F.col("role").alias("new"), "before", F.lit("").alias("text"),
    )
    texts = rows.select(
        "conv_id", F.lit(False).alias("tail"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
        F.lit(True).alias("is_text"), F.lit(None).cast("string").alias("new"), F.lit("").alias("before"), "text",
    )
    both = on_rows.unionByName(tails).unionByName(texts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None
        for batch in batches:
            out = []
            for conv, tail, turn, role, digest, is_text, new, before, text in _columns(batch, *key, "new", "before", "text"):
                if not is_text:
                    out += [(conv, None, ROLES[USER if b == "u" else ASSISTANT], "", "I") for b in before]
                    waits = None if tail else (conv, turn, role, digest, new)
                elif waits and waits[:4] == (conv, turn, role, digest):
                    out.append((conv, turn, waits[4] or role, text, "R" if waits[4] else "K"))
                    waits = None
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "turn", "role", "text", "edit"]
            )

    sorted_ = both.repartition("conv_id").sortWithinPartitions(*key)
    return sorted_.mapInArrow(merged, "conv_id long, turn long, role string, text string, edit string")


def text_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the lines ``role:text`` of :func:`repaired`'s rows, in their order."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, role, text in _columns(batch, "conv_id", "role", "text"):
                line = f"{role}:{text}".encode()
                if now == (conv,):
                    state.update(b"\n" + line)
                    continue
                if now:
                    out.append((now[0], state.hexdigest()))
                now, state = (conv,), hashlib.sha256(line)
            yield _pairs(out)
        if now:
            yield _pairs([(now[0], state.hexdigest())])

    return rows.mapInArrow(digests, "conv_id long, repaired_sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """A row of findings for each conversation of ``(conv_id, turn, role, text)``, and the repaired rows.

    Findings: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. Rows may
    have ``times``, how often they occur. Nulls in role or text count as a space, a null
    conv_id is a conversation of its own, null turns come first. Rows of one turn are
    ordered by role and digest of their text; repeated rows are duplicates. A role counts by
    its first letter, one without letter as no role. Other columns are ignored; an empty
    table gives none. Rows after repair are as in :func:`repaired`.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    times = F.col("times") if "times" in conversations.columns else F.lit(1)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), part("role"), part("text"), times.alias("times")
    )
    placed = faults(rows)
    edits = cheapest_edits(placed, segment)
    counts = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    whole = edits.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_list(F.struct("seg", "audit"))).getField("audit"), "").alias("audit"),
    ).withColumnRenamed("conv_id", "c")
    found = counts.join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return found, repaired(rows, placed, edits)


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """Findings of the damaged conversations and a digest of their repaired rows, for every conv_id."""
    found, rows = repair(damaged(conversations))
    digests = text_digests(rows).withColumnRenamed("conv_id", "d")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("id").eqNullSafe(F.col("d")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
