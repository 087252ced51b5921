"""Pairs of similar vectors and greedy clusters, exact and without a table of all pairs.

Equal vectors are collapsed first, so a group of copies costs one row. The rest is a
metric similarity join over two levels of pivots: every vector belongs to its nearest
pivot and there to the nearest pivot of the second level, and by the triangle inequality on
angles it has to be compared outside its own cell only with cells whose radius plus the
wanted angle reaches it. Each level has about the square root of the wanted number of cells,
so a task holds few pivots while cells stay bounded however many vectors there are. Cells are
cut into blocks of bounded size all the same, and a task compares one block with another,
emitting only the pairs found. Blocks are as large as a task can well hold, for a vector travels
once for each cell it visits; within a task the same test holds against cells of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinseworks.frames import durable, small_frame
from rinseworks.functions.expr import dot, ref
from rinseworks.types import ISSUE_SCHEMA

#: Rows of one block in a task that compares two, and those compared at once there.
HALL = 65_536
BLOCK = 2048
#: Rows that meet the pivots of the second level in one task.
PART = 65_536
_SLACK = 1e-6


def distinct_vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(id, copies, unit, vector)``: one row per distinct vector of non-zero length."""
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    return (
        df.where(ref(embedding).isNotNull())
        .groupBy(ref(embedding).alias("vector"))
        .agg(F.min(ref(key)).alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("norm", norm)
        .where(F.col("norm") > 0)
        .select(
            "id",
            "copies",
            F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("unit"),
            "vector",
        )
    )


def similar_pairs(
    df: DataFrame,
    key: str,
    embedding: str,
    threshold: float = 0.85,
    block: int = HALL,
    fan: int | None = None,
) -> DataFrame:
    """Unordered pairs with a cosine above the threshold.

    ``(id_a, id_b, copies_a, copies_b, pairs, similarity)`` over distinct vectors, each
    named by its smallest key; ``pairs`` counts the pairs of rows behind the entry. The
    pairs within a group of copies are one entry with ``id_a = id_b``. ``fan`` bounds the
    pivots of a level and of one of its cells.
    """
    vectors = durable(distinct_vectors(df, key, embedding).drop("vector"))
    return _pairs(vectors, threshold, block, fan)


def _pairs(vectors: DataFrame, threshold: float, block: int, fan: int | None) -> DataFrame:
    copies = vectors.where((F.col("copies") > 1) & F.lit(threshold < 1)).select(
        F.col("id").alias("id_a"),
        F.col("id").alias("id_b"),
        F.col("copies").alias("copies_a"),
        F.col("copies").alias("copies_b"),
        (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("pairs"),
        F.lit(1.0).alias("similarity"),
    )
    return copies.unionByName(_distinct_pairs(vectors, threshold, block, fan))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _near_pivots(rows: DataFrame, pivots: DataFrame, schema: str, choose) -> DataFrame:
    """Stream rows ``(id, copies, unit, top, part, home)`` past the pivots of their top.

    ``pivots`` has ``(top, part, sub, unit, radius)``; those of a top come before its rows.
    ``choose(pivots, rows)`` gets both as pandas frames, the rows in batches.
    """
    held = pivots.select(
        "top", "part", F.lit(False).alias("is_row"), "sub", "unit", "radius",
        *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "copies", "home")),
    )
    passing = rows.select(
        "top", "part", F.lit(True).alias("is_row"), F.lit(None).cast("int").alias("sub"), "unit",
        F.lit(None).cast("double").alias("radius"), "id", "copies", "home",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, []
        for batch in batches:
            place = batch["top"].to_numpy() * 2**32 + batch["part"].to_numpy()
            mark = place * 2 + batch["is_row"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                run_ = batch.iloc[a:b]
                if place[a] != now:
                    now, known = place[a], []
                if run_["is_row"].iloc[0]:
                    known = [pd.concat(known)] if len(known) > 1 else known
                    yield choose(known[0], run_)
                else:
                    known.append(run_)

    both = held.unionByName(passing).repartition("top", "part").sortWithinPartitions("top", "part", "is_row", "sub")
    return both.mapInPandas(run, schema)


def _cells(vectors: DataFrame, reach: float, block: int, fan: int | None) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, copies, unit, cell)`` and visitors, the same for the cells a vector
    has to be compared with beside its own; of two cells the earlier visits the later.

    The cell numbers are ordered by top and sub. Members are written; visitors are many, so they
    are found again for each use.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    wanted = math.ceil(4 * vectors.count() / block)  # a quarter of a block, for cells are uneven
    first = max(1, math.ceil(math.sqrt(wanted)))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(min(first, fan or first)).select("unit").collect()
    tops = np.array([r["unit"] for r in chosen]).reshape(len(chosen), -1)

    def at_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                turn = _angles(np.stack(rows["unit"].to_numpy()), tops)
                top = turn.argmin(axis=1)
                yield rows.assign(top=top, turn=turn[np.arange(len(rows)), top])

    base = f"id {kind}, copies bigint, unit array<double>"
    placed = durable(vectors.select("id", "copies", "unit").mapInPandas(at_top, f"{base}, top bigint, turn double"))
    found = placed.groupBy("top").agg(F.max("turn").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = np.full(len(tops), -math.inf)
    for r in found:
        radius[r.top] = r.radius
    sizes = small_frame(vectors.sparkSession, [
        (r.top, r.n, min(fan or r.n, math.ceil(4 * r.n / block)), math.ceil(r.n / PART)) for r in found
    ], "top bigint, n bigint, subs bigint, parts bigint")
    sized = placed.join(F.broadcast(sizes), "top")

    # Pivots of the second level: rows of the cell, or its own pivot if chance picks none.
    order = F.row_number().over(Window.partitionBy("top").orderBy("id")) - 1
    subs = sized.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.col("n")) < F.col("subs"))
    subs = subs.select("top", order.cast("int").alias("sub"), "unit")
    own = vectors.sparkSession.createDataFrame(
        [(int(r.top), 0, tops[r.top].tolist()) for r in found], "top bigint, sub int, unit array<double>"
    )
    subs = durable(subs.unionByName(own.join(subs.select("top").distinct(), "top", "left_anti")))
    of_parts = F.broadcast(sizes.select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")

    def home(pivots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        turn = _angles(np.stack(rows["unit"].to_numpy()), np.stack(pivots["unit"].to_numpy()))
        sub = turn.argmin(axis=1)
        return rows[["id", "copies", "unit"]].assign(
            cell=rows["top"] * 2**32 + pivots["sub"].to_numpy(int)[sub], turn=turn[np.arange(len(rows)), sub]
        )

    members = durable(_near_pivots(
        sized.select("id", "copies", "unit", "top", part, F.lit(None).cast("long").alias("home")),
        subs.join(of_parts, "top").withColumn("radius", F.lit(0.0)), f"{base}, cell bigint, turn double", home,
    ))
    filled = members.groupBy("cell").agg(F.max("turn").alias("radius"))
    pivots = subs.withColumn("cell", F.col("top") * 2**32 + F.col("sub")).join(filled, "cell").drop("cell")

    def guests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                turn = _angles(np.stack(rows["unit"].to_numpy()), tops)
                mine = rows["cell"].to_numpy() >> 32
                later = np.arange(len(tops)) >= mine[:, None]
                row, top = np.nonzero(later & (turn < radius + reach + _SLACK))
                yield rows.iloc[row][["id", "copies", "unit", "cell"]].rename(columns={"cell": "home"}).assign(top=top)

    def visited(pivots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        turn = _angles(np.stack(rows["unit"].to_numpy()), np.stack(pivots["unit"].to_numpy()))
        cell = rows["top"].to_numpy()[:, None] * 2**32 + pivots["sub"].to_numpy(int)
        row, sub = np.nonzero((cell > rows["home"].to_numpy()[:, None]) & (turn < pivots["radius"].to_numpy() + reach + _SLACK))
        return rows.iloc[row][["id", "copies", "unit"]].assign(cell=cell[row, sub])

    routed = members.drop("turn").mapInPandas(guests, f"{base}, home bigint, top bigint")
    visitors = _near_pivots(
        routed.join(F.broadcast(sizes), "top").select("id", "copies", "unit", "top", part, "home"),
        pivots.join(of_parts, "top"), f"{base}, cell bigint", visited,
    )
    return members.drop("turn"), visitors


def _likely(left: pd.DataFrame, right: pd.DataFrame, threshold: float, reach: float):
    """Places in both blocks and cosine of the pairs above the threshold, each pair once if both are one.

    The right block falls into cells around some of its rows; a cell meets the left rows that reach it.
    """
    found = [(np.array([], int), np.array([], int), np.array([], float))]
    if len(left) and len(right):
        hosts = np.stack(right["unit"].to_numpy())
        guests = hosts if left is right else np.stack(left["unit"].to_numpy())
        pivots = hosts[:: max(1, BLOCK // 4)]
        home, turn = np.empty(len(hosts), int), np.empty(len(hosts))
        for start in range(0, len(hosts), BLOCK):
            angles = _angles(hosts[start : start + BLOCK], pivots)
            home[start : start + BLOCK], turn[start : start + BLOCK] = angles.argmin(axis=1), angles.min(axis=1)
        for cell in range(len(pivots)):
            j = np.flatnonzero(home == cell)
            if not len(j):
                continue
            here, radius = hosts[j].T, turn[j].max() + reach + _SLACK
            for start in range(0, len(guests), BLOCK):
                part = guests[start : start + BLOCK]
                near = np.flatnonzero(_angles(part, pivots[cell : cell + 1])[:, 0] < radius)
                likeness = (part if len(near) == len(part) else part[near]) @ here
                a, b = np.nonzero(likeness > threshold)
                likeness, a, b = likeness[a, b], near[a] + start, j[b]
                if left is right:
                    once = a < b
                    likeness, a, b = likeness[once], a[once], b[once]
                found.append((a, b, likeness))
    return tuple(np.concatenate(part) for part in zip(*found))


def _distinct_pairs(vectors, threshold, block, fan):
    kind = vectors.schema["id"].dataType.simpleString()
    reach = math.acos(max(-1.0, min(1.0, threshold))) + _SLACK
    members, visitors = _cells(vectors, reach, block, fan)

    def parts(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = parts(members, "own").join(parts(visitors, "visiting"), "cell", "left").select(
        "cell", "own", F.coalesce("visiting", F.lit(0)).alias("visiting")
    )

    def part(count):
        return F.pmod(F.xxhash64("id"), count).cast("int")

    def span(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )

    carried = ["id", "copies", "unit"]
    members = members.join(sizes, "cell").select(
        *carried, "cell", part(F.col("own")).alias("part"), "own", "visiting"
    )
    within = members.select(
        *carried,
        "part",
        "cell",
        F.lit(False).alias("visit"),
        F.explode(span(F.col("own"))).alias("other"),
    ).select(
        *carried,
        "part",
        "cell",
        "visit",
        F.least("part", "other").alias("a"),
        F.greatest("part", "other").alias("b"),
    )
    hosts = members.select(
        *carried,
        F.lit(0).alias("part"),
        "cell",
        F.lit(True).alias("visit"),
        F.col("part").alias("a"),
        F.explode(span(F.col("visiting"))).alias("b"),
    )
    visitors = (
        visitors.join(sizes, "cell")
        .select(
            *carried,
            F.lit(1).alias("part"),
            "cell",
            F.lit(True).alias("visit"),
            part(F.col("visiting")).alias("b"),
            F.explode(span(F.col("own"))).alias("a"),
        )
        .select(*carried, "part", "cell", "visit", "a", "b")
    )

    def compare(task: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, visit, a, b = task
        side = rows["part"].to_numpy()
        left, right = (rows, rows) if not visit and a == b else (
            (rows[side == 0], rows[side == 1]) if visit else (rows[side == a], rows[side == b])
        )
        i, j, likeness = _likely(left, right, threshold, reach)
        one, two = left.iloc[i], right.iloc[j]
        swap = one["id"].to_numpy() > two["id"].to_numpy()

        def ordered(name):
            x, y = one[name].to_numpy(), two[name].to_numpy()
            return np.where(swap, y, x), np.where(swap, x, y)

        (id_a, id_b), (copies_a, copies_b) = ordered("id"), ordered("copies")
        return pd.DataFrame(
            {
                "id_a": id_a,
                "id_b": id_b,
                "copies_a": copies_a,
                "copies_b": copies_b,
                "pairs": copies_a * copies_b,
                "similarity": likeness,
            }
        )

    return (
        within.unionByName(hosts)
        .unionByName(visitors)
        .groupBy("cell", "visit", "a", "b")
        .applyInPandas(
            compare,
            f"id_a {kind}, id_b {kind}, copies_a bigint, copies_b bigint, pairs bigint, "
            "similarity double",
        )
    )


def detect_semantic_duplicates(
    df: DataFrame, key: str, embedding: str, threshold: float = 0.85
) -> DataFrame:
    """The issue of similar pairs; medium above five pairs."""
    pairs = similar_pairs(df, key, embedding, threshold)
    found = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    total = df.count()
    rows = []
    if found > 0:
        text = f"Column '{embedding}' has {found} similar pairs (similarity > {threshold})"
        share = 100.0 * found / total
        rows = [
            ("semantic_duplicates", embedding, found, share, "medium" if found > 5 else "low", text)
        ]
    return small_frame(df.sparkSession, rows, ISSUE_SCHEMA)


def cluster_similar(
    df: DataFrame, key: str, embedding: str, threshold: float = 0.8, block: int = HALL,
    fan: int | None = None,
) -> DataFrame:
    """``(leader, member)`` of greedy leader clusters with more than one member.

    In ascending key order every row not yet taken leads a cluster and takes the later
    rows similar to it. Equivalently a row leads exactly when no smaller neighbour
    leads, and joins its smallest leading neighbour; that form runs as rounds of joins
    over the pairs. A cluster is named by its leader's key.
    """
    groups = durable(distinct_vectors(df, key, embedding))
    edges = durable(
        _distinct_pairs(groups.drop("vector"), threshold, block, fan).select("id_a", "id_b")
    )
    taken, _ = _taken(edges)
    leading = edges.join(
        taken.select(F.col("id_b").alias("id_a")), "id_a", "left_anti"
    )
    chosen = (
        leading.join(taken, "id_b", "left_semi")
        .groupBy("id_b")
        .agg(F.min("id_a").alias("leader"))
    )
    owner = (
        groups.join(chosen, F.col("id") == F.col("id_b"), "left")
        .select("vector", "copies", F.coalesce("leader", "id").alias("leader"))
    )
    grown = (
        owner.groupBy("leader").agg(F.sum("copies").alias("members")).where(F.col("members") > 1)
    )
    kept = owner.join(grown.select("leader"), "leader", "left_semi").select("vector", "leader")
    return df.join(kept, ref(embedding) == F.col("vector")).select(
        "leader", ref(key).alias("member")
    )


def _taken(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(id_b)``, the vectors that do not lead, and the number of rounds that found them.

    A vector leads unless a smaller neighbour does. What is open about it is a set of
    conditions ``(on, flip)``: it is taken if ``on`` leads, or with ``flip`` if it does
    not. A vector on which nothing smaller is open leads; that settles the conditions on it.
    A vector with a single condition is the opposite of what that says, so conditions on it
    are put on the vector behind it instead. So the way along a chain of neighbours
    halves in each round. Opposite conditions on one vector take theirs at once.
    """
    open_ = durable(edges.select("id_b", F.col("id_a").alias("on"), F.lit(False).alias("flip")).distinct())
    settled: list[DataFrame] = []
    before = None  # what the last round took
    rounds = 0
    while not open_.isEmpty():
        rounds += 1
        each = open_.groupBy("id_b", "on").agg(F.count("*").alias("n"), F.first("flip").alias("flip"))
        per = durable(each.groupBy("id_b").agg(
            F.count("*").alias("n"), F.max("n").alias("most"), F.first("on").alias("behind"), F.first("flip").alias("turned")
        ))
        torn = per.where("most > 1").select("id_b")
        leads = open_.select("on").distinct().join(per.select(F.col("id_b").alias("on")), "on", "left_anti")
        known = leads.select("on", F.lit(True).alias("leads"))
        if before is not None:
            known = known.join(before.select(F.col("id_b").alias("on")), "on", "left_anti").unionByName(
                before.select(F.col("id_b").alias("on"), F.lit(False).alias("leads"))
            )
        known = durable(known)
        # What is settled now settles the conditions on it; nothing is put on it any more.
        single = per.where("n = 1 and most = 1").select(F.col("id_b").alias("on"), "behind", "turned").join(
            known.select(F.col("on").alias("behind")), "behind", "left_anti"
        )
        state = durable(open_.join(known, "on", "left"))
        taken = durable(state.where("leads <> flip").select("id_b").unionByName(torn).distinct())
        settled.append(taken)
        left = state.where("leads is null").drop("leads").join(taken, "id_b", "left_anti").join(single, "on", "left")
        before = taken
        open_ = durable(left.select(
            "id_b", F.coalesce("behind", "on").alias("on"),
            F.when(F.col("behind").isNull(), F.col("flip")).otherwise(F.expr("flip = turned")).alias("flip"),
        ).distinct())
    out = edges.select("id_b").limit(0)
    for taken in settled:
        out = out.unionByName(taken)
    return out, rounds
