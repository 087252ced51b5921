"""Nearest neighbours against all inner products."""

import numpy as np
import pytest

from rinseworks.llm import neighbours as n

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score double"


def table(seed=1, size=1_500, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = (centres[rng.integers(0, 8, size)] + 0.4 * rng.normal(size=(size, width))) * rng.uniform(0.5, 2, (size, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(2_000 + i, rows[7][1]) for i in range(700)]  # a third has one vector
    rows += [(40, rows[3][1]), (40, rows[3][1]), (None, rows[40][1]), (None, rows[7][1])]
    odd = [None, [0.0] * width, [-0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [1.0], [], [None] + [1.0] * (width - 1)]
    return rows + [(9_000 + 20 * i, v) for i, v in enumerate(odd)]


def brute(rows, k):
    part = [(i, np.array(v, np.float64)) for i, v in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v for _, v in part])
    out = []
    for at, (i, q) in enumerate(part):
        if i is None or i % 20:
            continue
        scores = (x * q).sum(axis=1)
        best = sorted((-s, j is None, j or 0) for t, ((j, _), s) in enumerate(zip(part, scores)) if t != at)[:k]
        out.append((i, [(None if none else j, float(-s)) for s, none, j in best]))
    return out


def lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


@pytest.mark.parametrize("options", [{}, {"group": 200, "queries": 7, "sample": 300, "leaf": 10, "branches": 4}])
def test_all_leaves_give_the_exact_answer(spark, options):
    rows = table()
    frame = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA).repartition(4)
    got, want = lists(n.every_twentieth(frame, recall=1.0, probes=5_000, **options)), {}
    for i, best in brute(rows, 20):
        want.setdefault(i, []).append(best)
    assert set(got) == set(want)
    for i, answers in want.items():
        flat = sorted((r + 1, j, s) for best in answers for r, (j, s) in enumerate(best)) if len(answers) == 1 else None
        if flat is not None:
            assert got[i] == flat, i
        else:  # rows that share a query's vec_id are queries of their own
            assert sorted(map(str, got[i])) == sorted(str((r + 1, j, s)) for best in answers for r, (j, s) in enumerate(best))


def test_recall_of_the_calibrated_search(spark):
    rows = [(i, v) for i, v in table(5, 6_000)][:6_000]
    frame = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA).repartition(4)
    got = lists(n.every_twentieth(frame, sample=2_000, group=1_000))
    hits = [len({j for j, _ in best} & {j for _, j, _ in got[i]}) for i, best in brute(rows, 20)]
    assert sum(hits) / (20 * len(hits)) >= 0.9
    for i, best in brute(rows, 20)[:40]:
        by_id = dict(best)
        assert all(s == by_id[j] for _, j, s in got[i] if j in by_id)


def test_few_rows_and_none(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA)
    assert n.every_twentieth(frame([])).collect() == []
    assert n.every_twentieth(frame([(0, None), (20, [0.0])])).collect() == []
    assert n.every_twentieth(frame([(0, [1.0, 2.0])])).collect() == []
    got = n.every_twentieth(frame([(0, [1.0, 2.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (1, [-1.0, 0.0])])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 3.0), (0, 2, 3, 3.0), (0, 3, 1, -1.0)]


def test_groups_are_bounded():
    counts = {0: 5, 1: 50, 2: 3, 3: 3, 5: 9}
    first, parts = n.grouped(counts, 6, 10)
    load = {}
    for leaf, c in counts.items():
        for g in range(first[leaf], first[leaf] + parts[leaf]):
            load[g] = load.get(g, 0) + c / parts[leaf]
    assert max(load.values()) <= 10 and len(load) == 8


def test_tree_of_equal_points():
    tree = n.Tree(np.ones((100, 3)), 2.0)
    assert tree.leaves == 1 and tree.first_leaves(np.ones((2, 3)), 5) == [[0], [0]]
