"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rinseworks.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, place string, seg long"
LETTER = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def expected(rows):
    """Cheapest edits by Dijkstra over (cost, audit); rows of one conversation, in order."""
    kinds, seen = [], set()
    for _, _, role, text in rows:
        letters = LETTER.findall(text)
        kinds.append(
            "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")
    prefix = re.compile("(s?(ua)*u?)?")
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, initials, left = heapq.heappop(queue)
        if i == len(rows) and legal.fullmatch(initials):
            break
        state = (i, initials[-2:])
        if state in done and (i, initials[-2:], "") in done:
            continue
        done |= {state, (i, initials[-2:], "")}
        steps = [("I", 5, i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            steps.append(("D", 2, i + 1, None, None))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 * (kinds[i] == "truncated")
                steps.append(("K", extra, i + 1, rows[i][2], rows[i][2:]))
                steps += [("R", 1 + extra, i + 1, r, (r, rows[i][3])) for r in ("user", "assistant")]
        for name, price, j, role, row in steps:
            new = initials if role is None else initials + (role[:1] or "?")
            if prefix.fullmatch(new):
                heapq.heappush(queue, (cost + price, audit + name, j, new, left if row is None else left + (row,)))
    turns = [t for _, t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
    }


def awkward(seed, n=150):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t\n", None, "Ünï?", "a. b", "end.\n\n", "why? \x0b"]
    roles = ["user", "assistant", "system", "u", None, "", "tool", "User"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Line {rng.randint(0, 40)}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, "assistant", "Ha.")]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Text {t % 37}" + ".!"[t % 2] * (t % 11 > 0)) for t in range(700)]
    return rows


@pytest.mark.parametrize("segment", [3, c.SEGMENT])
def test_repairs_equal_search_over_edit_strings(spark, segment, monkeypatch):
    rows = awkward(segment)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(c, "cheapest_edits", lambda placed, _, run=c.cheapest_edits: run(placed, segment))
    got = {r.conv_id: r.asDict() for r in c.conversation_repairs(frame).collect()}
    by_conv = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        by_conv[row[0]].append(row)
    assert set(got) == set(by_conv)
    for conv, lines in by_conv.items():
        found = got[conv]
        found.pop("conv_id")
        assert found == expected(ordered(lines)), (conv, lines[:9])


def test_repaired_rows_read_well(spark):
    rows = awkward(9, 40)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    _, fixed = c.repair(frame)
    roles = {}
    for r in fixed.collect():
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())


def test_empty_conversations(spark):
    assert c.conversation_repairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_conversation_of_all_rows_is_split(spark):
    """One conversation of 20,000 rows: many segments, and the same edits whatever their length."""
    rows = spark.range(20_000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 9 < 5, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("Line "), F.col("id"), F.lit(".")).alias("text"),
    )
    placed = c.faults(rows.withColumn("times", F.lit(1)))
    short, long = (c.cheapest_edits(placed, s) for s in (16, 48))
    assert short.count() >= 20_000 / 16
    joined = [
        "".join(r.audit for r in e.orderBy("seg").collect()) for e in (short, long)
    ]
    assert joined[0] == joined[1]
