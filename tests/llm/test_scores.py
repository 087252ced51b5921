"""Scores and fingerprints against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rinseworks.llm import fingerprint, quality, toxicity

SPACE = "\t\n\x0b\f\r "


def naive_features(text):
    """The features of op1 of one text, byte by byte and word by word."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    n, size = len(words), max(1, len(data))

    def kind(b):
        c = chr(b)
        if b >= 128:
            return 8
        if c.islower() or c.isupper():
            return 0 if c.islower() else 1
        if c.isdigit():
            return 2
        for k, chars in ((3, "\t\x0b\f "), (4, "\n\r"), (5, ".,;:?!"), (6, "()[]{}<>\"'"), (7, "#$%&*|@~^_=+\\/-`")):
            if c in chars:
                return k
        return 8

    kinds = Counter(map(kind, data))
    lines = kinds[4] + (len(data) > 0)
    pairs = list(zip(words, words[1:]))
    full = [x for x in data.split(b"\n") if x.strip()]
    of = [Counter(map(kind, w)) for w in words]
    marks = [c[7] for c in of]
    signs = [c[5] + c[6] + c[7] for c in of]
    return [
        math.log1p(n), sum(map(len, words)) / max(1, n), math.log1p(max(map(len, words), default=0)),
        *(kinds[k] / size for k in range(9)),
        len(set(words)) / n if n else 0, 1 - len(set(pairs)) / len(pairs) if pairs else 0,
        1 - len(set(full)) / len(full) if n else 0,
        math.log1p(n / max(lines, 1)), math.log1p(n / (1 + kinds[5])),
        sum(c[1] >= 2 and 2 * c[1] >= len(w) for c, w in zip(of, words)) / max(1, n),
        sum(s == len(w) for s, w in zip(signs, words)) / max(1, n),
        sum(0 < m < len(w) for m, w in zip(marks, words)) / max(1, n),
        max(Counter(words).values()) / n if n else 0,
    ]


TEXTS = [
    "The cat sat. The cat sat!\nThe cat sat.", None, "", " \n\t", "ONE", "a-b $$ (x) [] 12 é日本 word's USA", "x" * 500,
    "same line\nsame line\n\nsame line", "w " * 300, "tabs\tand\x0bothers\fhere\r\nend",
]


def test_quality_features_and_sums():
    got = quality.features(pa.array(TEXTS))
    assert np.allclose(got, [naive_features(t) for t in TEXTS])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    model = quality.train(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=20, pair_rounds=10)
    for row, margin in zip(x, model.margin(x)):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.constant + sum(model.tables[k, b] for k, b in enumerate(bins))
        total += sum(model.pair_tables[i, bins[a], bins[b]] for i, (a, b) in enumerate(model.pairs))
        assert math.isclose(total, margin, abs_tol=1e-9)


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality(docs, labels).collect() == []


def naive_chain(text, rank):
    """Windows, runs and picks by loops; filters from the picks' hashes."""
    data = np.frombuffer(text.encode(), np.uint8)
    w, run = fingerprint.WINDOW, fingerprint.RUN
    n = len(data) - w + 1
    ranks = [int(rank[c]) for c in fingerprint.entropy_classes(data)] if n > 0 else []
    points = Counter()
    for start in range(n - run + 1):
        points[min(range(start, start + run), key=lambda i: (ranks[i], i))] += 1
    if 0 < n < run:
        points[min(range(n), key=lambda i: (ranks[i], i))] = fingerprint.POINTS
    return [i for i in range(max(n, 0)) if points[i] >= fingerprint.POINTS and ranks[i] < fingerprint.CLASSES]


def test_fingerprint_features_by_hand():
    rng = random.Random(5)
    vocabulary = [f"w{i}x" * rng.randint(1, 3) for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(k)) for k in (3, 12, 20, 60, 400)]
    texts += ["", "ab", "é" * 70, "aaaa" * 60 + texts[2]]
    histogram = np.random.default_rng(6).integers(0, 1000, fingerprint.CLASSES)
    rank = fingerprint.rarity(histogram)
    order = sorted(range(fingerprint.CLASSES), key=lambda c: (histogram[c], c))
    low = fingerprint.CLASSES // 10
    assert [int(rank[c]) for c in order if c >= low] == [i for i, c in enumerate(order) if c >= low]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = fingerprint.chains(data, offsets, rank)
    for text, chain in zip(texts, together):
        alone = fingerprint.chains(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), rank)
        assert fingerprint.written(chain) == fingerprint.written(alone[0])
        picks = naive_chain(text, rank)
        assert sum(n for n, _ in chain) == (len(picks) or bool(text))
        assert all(n <= fingerprint.FILTER_FEATURES and bits.sum() <= n * fingerprint._HASHES for n, bits in chain)


def naive_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            most, chance = min(x.sum(), y.sum()), x.sum() * y.sum() / len(x)
            best = max(best, min(1.0, max(0.0, ((x & y).sum() - chance) / max(most - chance, 1e-6))))
        total += n * best
    return total / sum(n for n, _ in a)


def test_likeness_of_filters_by_loops():
    rng = np.random.default_rng(7)
    chains = [[]] + [
        [fingerprint._filter(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in sizes] for sizes in ((1,), (40, 3), (64, 64, 9), (2, 2))
    ]
    chains.append(chains[3][1:] + chains[1])
    for a in chains:
        for b in chains:
            assert math.isclose(fingerprint.likeness(a, b), naive_likeness(a, b), abs_tol=1e-5)


def test_toxic_entries_by_plain_search():
    rng = random.Random(8)
    words = ["idiot", "idiotic", "fool", "moron", "bad", "kind", "of", "you", "not", "fools"]
    lexicon = toxicity.Lexicon(
        {" idiot": 2.0, " fool ": 1.5, " moron ": 3.0, " bad ": 0.5}, ("not bad", "kind fool", "you moron"), (-3.0, 1.0, 0.5, 0.7)
    )
    automaton = lexicon.automaton()
    for _ in range(300):
        text = toxicity.folded(rng.choice(["", "!! ", "ID10T "]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        found, spared = [], []
        for entry in [*lexicon.weights, *(f" {p} " for p in lexicon.exceptions)]:
            at = text.find(entry)
            while at >= 0:
                (found if entry in lexicon.weights else spared).append((at, at + len(entry) - 1, entry))
                at = text.find(entry, at + 1)
        kept = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in spared)]
        assert sorted(lexicon.spans(automaton, text)) == sorted(kept)
        weights = [lexicon.weights[e] for *_, e in kept]
        n = max(1, len(text.split()))
        want = (max(weights, default=0.0), math.log1p(sum(weights)), sum(weights) / math.sqrt(n))
        assert np.allclose(lexicon.features(automaton, text), want)
        margin = -3.0 + want[0] + 0.5 * want[1] + 0.7 * want[2]
        assert np.allclose(lexicon.scores(np.array([want])), [1 / (1 + math.exp(-margin))])


def test_window_fingerprints_are_of_their_bytes_alone():
    digest = hashlib.blake2b(b"ab", digest_size=8).digest()
    (chain,) = fingerprint.chains(np.frombuffer(b"ab", np.uint8), np.array([0, 2]), np.arange(fingerprint.CLASSES))
    assert chain[0][0] == 1 and (chain[0][1] == fingerprint._filter(np.frombuffer(digest, np.uint64))[1]).all()
