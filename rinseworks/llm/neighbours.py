"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

A vector x becomes (x, sqrt(M**2 - |x|**2)), M being the largest norm, and a query (q, 0).
The nearest of these points have the largest inner products, so an ordinary k-means tree
serves. Best-bin-first: a priority queue holds the nodes seen by the distance of their
centre; the nearest is opened, and a leaf that comes out of the queue is visited.

1. Rows become distinct vectors, each with the ``k + 1`` rows of smallest vec_id that hold
   it; no query can need another of its rows.
2. The tree is fitted on a bounded sample of distinct vectors, every vector gets its leaf.
3. A bounded sample of queries is answered exactly, by a scan; the visits are widened until
   the leaves that come out of the queue first hold the wanted share of these answers.
4. Neighbouring leaves form groups of bounded size, a larger leaf several. A query goes
   to the groups of its leaves as one row, first to that of its first leaf; to the others it
   carries the score to beat. A group's vectors are held by a task while its queries stream by.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable, small_frame

K, SAMPLE, LEAF, BRANCHES, RECALL, PROBES = 20, 16_384, 32, 16, 0.95, 256
GROUP, QUERIES = 32_768, 65_536
_IDS = "array<struct<none:boolean,vec_id:long,row:long>>"


class Tree:
    """A k-means tree over points on the unit scale; leaves are numbered in depth-first order."""

    def __init__(self, points: np.ndarray, peak: float, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 0):
        self.peak = peak
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        lifted = self.lift(points)
        self._grow(lifted, lifted.mean(axis=0), leaf, branches, rng)
        self.centres = np.stack(self.centres)
        self.squares = (self.centres**2).sum(axis=1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.peak
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))])

    def _grow(self, points: np.ndarray, centre: np.ndarray, leaf: int, branches: int, rng) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf_of.append(-1)
        parts = _split(points, branches, rng) if len(points) > leaf else []
        if len(parts) > 1:
            self.children[node] = [self._grow(p, p.mean(axis=0), leaf, branches, rng) for p in parts]
        else:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        x, out = self.lift(x), np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            nearest = np.argmin(self.squares[kids] - 2 * x[rows] @ self.centres[kids].T, axis=1)
            stack += [(kid, rows[nearest == i]) for i, kid in enumerate(kids) if (nearest == i).any()]
        return out

    def first_leaves(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """For each query the leaves in the order in which best-bin-first visits them."""
        norms = np.linalg.norm(queries / self.peak, axis=1, keepdims=True)
        lifted = np.column_stack([queries / self.peak / np.where(norms > 0, norms, 1), np.zeros(len(queries))])
        out = []
        for far in self.squares - 2 * lifted @ self.centres.T:
            far, queue, leaves = far.tolist(), [(0.0, 0)], []
            while queue and len(leaves) < visits:
                _, node = heapq.heappop(queue)
                if self.leaf_of[node] >= 0:
                    leaves.append(self.leaf_of[node])
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], kid))
            out.append(leaves)
        return out


def _split(points: np.ndarray, branches: int, rng, rounds: int = 8) -> list[np.ndarray]:
    """k-means with centres drawn from the points; equal points give one part."""
    centres = np.unique(points[rng.choice(len(points), min(branches, len(points)), replace=False)], axis=0)
    nearest = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        used = np.unique(nearest)
        centres = np.stack([points[nearest == i].mean(axis=0) for i in used])
        nearest = np.searchsorted(used, nearest)
    return [points[nearest == i] for i in np.unique(nearest)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products that depend on the two vectors alone, not on their neighbours."""
    return (rows * query).sum(axis=1)


def best(rows: np.ndarray, least: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int, beat: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best rows of at least ``beat``, ties to the smaller ``least``.

    ``rough`` are scores up to rounding; what is near the cut is scored again.
    """
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    cut = max(beat, np.partition(rough, -k)[-k]) if len(rough) > k else beat
    at = np.flatnonzero(~(rough < cut - slack))
    scores = inner(rows[at], query)
    order = np.lexsort((least[at], -scores))[:k]
    order = order[scores[order] >= beat]
    return at[order], scores[order]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a vector that takes part, ``row, vec_id, vec, key, size``, written, and their width.

    Vectors that are null, zero or hold a null or a non-finite number take no part, nor do
    those of another width than most rows have (ties: the larger width).
    """
    real = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vec")).where(F.col("vec").isNotNull() & real)
    widest = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widest.width if widest else 0

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), width) + 0.0  # no negative zeros
            norms = [float(n) for n in np.linalg.norm(x / 2, axis=1)]
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary()), pa.array(norms, pa.float64())], [*batch.schema.names, "key", "half"]
            )

    kind = rows.schema["vec"].dataType.simpleString()
    rows = rows.where(F.size("vec") == width).mapInArrow(named, f"vec_id long, vec {kind}, key binary, half double")
    return durable(rows.withColumn("row", F.monotonically_increasing_id())), width


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``key, vec, half, ids``: each vector once with the ``k`` of its rows of smallest vec_id, nulls last."""
    by_id = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    first = rows.select("*", F.expr("row_number() over (partition by key order by vec_id is null, vec_id, row)").alias("n"))
    first = first.where(F.col("n") <= k)  # each task drops the rest before the shuffle
    return durable(first.groupBy("key").agg(
        F.first(F.when(F.col("n") == 1, F.col("vec")), ignorenulls=True).alias("vec"), F.max("half").alias("half"),
        F.array_sort(F.collect_list(by_id)).alias("ids"),
    ))


def _least(ids: pa.Array) -> np.ndarray:
    """The smallest vec_id of each row's ids; null comes last."""
    first = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]))
    return first.field("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def exact_leaves(placed: DataFrame, probes: np.ndarray, k: int) -> dict[int, list[int]]:
    """For each probe the leaves of its ``k`` nearest vectors, by a scan of all.

    A task hands over at most ``k`` rows for each of the boundedly many probes.
    """
    width = probes.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(probes)
        for batch in batches:
            scores, leaf = matrix(batch.column("vec"), width) @ probes.T, batch.column("leaf").to_numpy()
            for p in range(len(probes)):
                s, l = np.concatenate([kept[p][0], scores[:, p]]), np.concatenate([kept[p][1], leaf])
                top = np.argsort(-s, kind="stable")[:k]
                kept[p] = s[top], l[top]
        sizes = [len(s) for s, _ in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(probes)), sizes)), pa.array(np.concatenate([l for _, l in kept])),
             pa.array(np.concatenate([s for s, _ in kept]))], ["probe", "leaf", "score"],
        )

    found = placed.select("vec", "leaf").mapInArrow(scan, "probe long, leaf long, score double")
    top = found.select("*", F.expr("row_number() over (partition by probe order by score desc)").alias("n")).where(f"n <= {k}")
    return {r.probe: r.leaves for r in top.groupBy("probe").agg(F.collect_list("leaf").alias("leaves")).collect()}


def visits_needed(tree: Tree, probes: np.ndarray, answers: dict[int, list[int]], recall: float) -> int:
    """The fewest leaves to visit so that the visited leaves hold the wanted share of all answers."""
    ranks: list[int] = []
    for p, leaves in enumerate(tree.first_leaves(probes, tree.leaves)):
        at = {leaf: i + 1 for i, leaf in enumerate(leaves)}
        ranks += [at[leaf] for leaf in answers.get(p, [])]
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def grouped(counts: dict[int, int], leaves: int, most: int) -> tuple[list[int], list[int]]:
    """First group and number of groups of each leaf, so that no group holds over about ``most`` rows."""
    first, parts, group, filled = [], [], 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if filled and filled + n > most:
            group, filled = group + 1, 0
        first.append(group)
        parts.append(max(1, -(-n // most)))
        if parts[-1] > 1:
            group, filled = group + parts[-1], 0
        else:
            filled += n
    return first, parts


def nearest(
    vectors: DataFrame, asks: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF,
    branches: int = BRANCHES, probes: int = PROBES, group: int = GROUP, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``asks`` its ``k`` nearest other rows.

    ``vectors`` has ``vec_id, embedding``; which take part see :func:`usable`. Ties go to the
    smaller vec_id, a null one last. Rows that repeat a vec_id are rows of their own, as are
    copies of a vector; a row is no neighbour of itself. With fewer than ``k`` other rows all
    are returned, without any nothing is. Other columns are ignored. The tree is fitted on
    ``sample`` vectors, visits are calibrated on ``probes`` vectors, both chosen by hash.
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vecs = distinct_vectors(rows, k + 1)
    kind = vecs.schema["vec"].dataType.simpleString()
    chosen = vecs.select("vec").orderBy(F.xxhash64("key"), "key").limit(sample)
    fitted = matrix(chosen.toArrow().column("vec").combine_chunks(), width)
    peak = min(2 * vecs.agg(F.max("half")).first()[0], 1e300)
    tree = Tree(fitted, peak, leaf, branches)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.assign(matrix(batch.column("vec"), width))))

    placed = durable(vecs.drop("half").mapInArrow(put, f"key binary, vec {kind}, ids {_IDS}, leaf long"))
    asked = placed.select("vec").orderBy(F.xxhash64(F.lit(1), "key"), "key").limit(probes)
    asked = matrix(asked.toArrow().column("vec").combine_chunks(), width)
    visits = visits_needed(tree, asked, exact_leaves(placed, asked, k), recall)
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
    first, parts = grouped(counts, tree.leaves, group)
    of_leaf = small_frame(spark, list(zip(range(tree.leaves), first, parts)), "leaf bigint, first bigint, parts bigint")
    held = placed.join(F.broadcast(of_leaf), "leaf").select(
        F.expr("first + pmod(xxhash64(key), parts)").alias("group"), "key", "vec", "ids", "leaf"
    )
    query_rows = rows.where(asks).select(F.col("vec_id").alias("query_id"), "row", "key")
    query_keys = query_rows.select("key").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            x = matrix(batch.column("vec"), width)
            for i, leaves in enumerate(tree.first_leaves(x, visits)):
                to: dict[int, list[int]] = {}
                for one in leaves:
                    for g in range(first[one], first[one] + parts[one]):
                        to.setdefault(g, []).append(one)
                out += [(i, g, n == 0, seen) for n, (g, seen) in enumerate(to.items())]
            at, groups, home, seen = zip(*out) if out else ((), (), (), ())
            taken = batch.select(["key", "vec"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(groups, pa.int64()), pa.array(home, pa.bool_()), pa.array(seen, pa.list_(pa.int64()))],
                ["key", "vec", "group", "home", "leaves"],
            )

    routed = durable(placed.join(query_keys, "key", "left_semi").select("key", "vec").mapInArrow(
        route, f"key binary, vec {kind}, group long, home boolean, leaves array<long>"
    ))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a group come before its queries; ``asks`` marks the queries."""
        now, parts_, x, leaf_, least, ids = None, [], None, None, None, None
        for batch in batches:
            marks = batch.column("group").to_numpy() * 2 * queries + batch.column("part").to_numpy() * 2 + np.asarray(batch.column("asks"), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                run = batch.slice(a, b - a)
                where = (run.column("group")[0].as_py(), run.column("part")[0].as_py())
                if not run.column("asks")[0].as_py():
                    if where != now:
                        now, parts_ = where, []
                    parts_.append(run)
                    x = None
                    continue
                if where != now or not parts_:
                    continue  # no vectors there
                if x is None:
                    whole = pa.Table.from_batches(parts_).combine_chunks().to_batches()[0]
                    x, leaf_, ids = matrix(whole.column("vec"), width), whole.column("leaf").to_numpy(), whole.column("ids")
                    least, order = _least(ids), np.argsort(leaf_, kind="stable")
                    starts = np.searchsorted(leaf_[order], np.arange(tree.leaves + 1))
                    x, least, ids = x[order], least[order], ids.take(pa.array(order))
                q = matrix(run.column("vec"), width)
                keys, beats, seen = run.column("key"), run.column("beat").to_pylist(), run.column("leaves").to_pylist()
                for c in range(0, len(q), 64):
                    rough = q[c : c + 64] @ x.T
                    got = []
                    for i in range(c, min(c + 64, len(q))):
                        at = np.concatenate([np.arange(starts[s], starts[s + 1]) for s in seen[i]])
                        if len(at):
                            found, scores = best(x[at], least[at], q[i], rough[i - c][at], k + 1, beats[i])
                            got.append((i, at[found], scores))
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [
                                keys.take(pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]))),
                                pa.array(np.concatenate([g[2] for g in got])),
                                ids.take(pa.array(np.concatenate([g[1] for g in got]))),
                            ],
                            ["key", "score", "ids"],
                        )

    def visit(pairs: DataFrame) -> DataFrame:
        """The ``k + 1`` best vectors of each query in each of its groups that are at least ``beat``."""
        load = pairs.groupBy("group").agg(F.ceil(F.count("*") / queries).cast("long").alias("n"))
        asking = pairs.join(load, "group").select(
            "group", F.expr("pmod(xxhash64(key), n)").alias("part"), F.lit(True).alias("asks"), "key", "vec",
            F.lit(None).cast(_IDS).alias("ids"), F.lit(None).cast("long").alias("leaf"), "beat", "leaves",
        )
        answering = held.join(load, "group").select(
            "group", F.explode(F.expr("sequence(0L, n - 1)")).alias("part"), F.lit(False).alias("asks"), "key", "vec",
            "ids", "leaf", F.lit(None).cast("double").alias("beat"), F.lit(None).cast("array<long>").alias("leaves"),
        )
        both = asking.unionByName(answering).repartition("group", "part").sortWithinPartitions("group", "part", "asks")
        return durable(both.mapInArrow(look, f"key binary, score double, ids {_IDS}"))

    lowest = F.lit(float("-inf"))
    home = visit(routed.where("home").select("key", "vec", "group", "leaves", lowest.alias("beat")))
    beat = home.groupBy(F.col("key").alias("q")).agg(
        F.when(F.count("*") > k, F.min("score")).otherwise(lowest).alias("beat")
    )
    away = routed.where("not home").select("key", "vec", "group", "leaves").join(beat, F.col("key") == F.col("q"), "left")
    found = home.unionByName(visit(away.drop("q").withColumn("beat", F.coalesce("beat", lowest))))
    ranked = found.select(
        "*", F.expr("row_number() over (partition by key order by score desc, ids[0].none, ids[0].vec_id)").alias("n")
    ).where(F.col("n") <= k + 1)
    members = ranked.select("key", F.expr("-score").alias("far"), F.explode("ids").alias("id")).select(
        "key", F.struct("far", "id.none", "id.vec_id", "id.row").alias("hit")
    )
    lists = members.groupBy("key").agg(  # at most (k + 1) ** 2 members
        F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("hits")
    )
    answers = query_rows.join(lists, "key").select(
        "query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, k)).alias("rank", "hit")
    )
    return answers.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def every_twentieth(vectors: DataFrame, **options) -> DataFrame:
    """The neighbours of the rows whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0, **options)
