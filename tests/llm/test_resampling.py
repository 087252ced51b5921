"""Importance resampling against loops over words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rinseworks.llm import resampling as r

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def naive(text):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def documents(seed=3, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ÄPFEL", "ἔργον", "日本語", "x" * 900, "A", "9", "b2b"]
    rows = []
    for i in range(n):
        k = rng.choice([1, 2, 3, 19, 20, 21, 60])
        rows.append((i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(k))))
    rows += [(1000, None), (1001, ""), (1002, " .,\x7f"), (1003, "word " * 40_000), (None, "w1 " * 30), (5, "w2 " * 25), (5, "w2 " * 25)]
    return rows


def test_equal_to_loops_over_words(spark):
    docs = documents()
    target = [(1, "w1 w2 w3 w4 w5"), (2, None), (3, "ÄPFEL b2b w7 w8 w9 " * 5)]
    s, t = (Counter(bucket(f) for _, x in rows for f in naive(x)[1]) for rows in (docs, target))
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))

    want = []
    for key, text in docs:
        n_words, found = naive(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    ranks = {id(w): i + 1 for i, w in enumerate(able[: len(able) * 5 // 100])}
    schema = "doc_id long, text string, score double, rank string, eligible int"
    frame = spark.createDataFrame([(i, x, 0.5, "x", 1) for i, x in docs], schema).repartition(4)
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = r.resample(frame, goal).collect()
    order = lambda rows: sorted(rows, key=lambda x: tuple((v is None, v or 0) for v in x))
    assert order(map(tuple, got)) == order((*w[:4], ranks.get(id(w))) for w in want)
    assert sum(x.rank is not None for x in got) == len(able) * 5 // 100 > 0


def test_checksums_of_joined_parts():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 7, 64, 1000, 70_001]))) for _ in range(60)]
    left, right = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = r.joined_checksums(left, right, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_runs_do_not_cross_texts():
    texts = pa.array(["a b", None, "c", "", "d e f g"])
    sizes = [np.diff(first).tolist() for _, first in r.features(texts)]
    assert sizes == [[2, 0, 1, 0, 4], [1, 0, 0, 0, 3], [0, 0, 0, 0, 2]]
    assert [len(b) for b, _ in r.features(pa.array([None, ""], pa.string()))] == [0, 0, 0]


def test_slices_of_a_batch_have_their_own_words():
    texts = ["One, two", "ÄPFEL b2b", "", "C d-e", " ", "LAST"]
    for start, size in [(s, n) for s in range(6) for n in (1, 2, 6)]:
        found, first = r.words(pa.array(texts).slice(start, size))
        want = [WORD.findall(lower(t)) for t in texts[start : start + size]]
        assert found.to_pylist() == sum(want, [])
        assert np.diff(first).tolist() == [len(w) for w in want]


def test_texts_of_several_pieces(spark):
    docs = [(i, f"Word{i} AND more " * 60_000) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x for x in r.resample(frame, spark.createDataFrame([(1, "word3 and")], "item_id long, text string")).collect()}
    assert {x.n_features for x in got.values()} == {3 * 180_000 - 3}
    assert max(got.values(), key=lambda x: x.weight).doc_id == 3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert r.resample(empty, empty).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(x.n_features, x.weight, x["rank"]) for x in r.resample(some, empty).collect()] == [
        (6, sum(math.floor(1000 * math.log(10_006 / 20_000)) for _ in range(6)), None)
    ]


def test_ties_go_to_the_smaller_key(spark):
    assert r.noise(None) == r.noise(None) != r.noise(0)
    rows = [(i % 7, "w " * 30) for i in range(700)]
    got = r.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    drawn = sorted((x["rank"], x.score, x.doc_id) for x in got.collect() if x["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, 36))
    assert [d[1:] for d in drawn] == sorted((d[1:] for d in drawn), key=lambda d: (-d[0], d[1]))
