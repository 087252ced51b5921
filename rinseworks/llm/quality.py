"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins, and the model is a table of values for each
feature and for a few pairs of features. Training is cyclic gradient boosting: feature
after feature, a shallow tree over that feature's bins is fitted to the current residuals
and added to its table; then pairs are ranked by the residual they explain and boosted the
same way with trees that cut both features once. A text's score is the logistic of the
sum of its table values, so scoring a batch is one lookup and one addition per table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.llm.learning import fold, labelled_sample, sigmoid
from rinseworks.llm.words import bytes_of, pieces, split, windows, word_numbers

SAMPLE = 20_000
_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "bracket", "mark", "other")
FEATURES = (
    "log_words", "word_length", "longest_word", *(f"share_{c}" for c in _CLASSES),
    "distinct_words", "repeated_pairs", "repeated_lines", "words_per_line", "words_per_stop",
    "capital_words", "lone_marks", "marked_words", "top_word",
)


def _class_of_byte() -> np.ndarray:
    out = np.full(256, 8, np.uint8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[9, 11, 12, 32]], out[[10, 13]] = 3, 4
    for signs, k in ((b".,;:?!", 5), (b"()[]{}<>\"'", 6), (b"#$%&*|@~^_=+\\/-`", 7)):
        out[list(signs)] = k
    return out


_CLASS = _class_of_byte()


def features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` per text, over the whole text; an empty one has zeros."""
    n = len(texts)
    data, offsets = bytes_of(texts)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    shares = np.bincount(owner * 9 + kind, minlength=9 * n).reshape(n, 9)
    _, starts, ends, first = split(texts)
    numbers, _ = word_numbers(texts)
    words = np.diff(first)
    of_word = np.repeat(np.arange(n), words)
    length = ends - starts

    def per_text(values, weights=None):
        return np.bincount(values, weights, minlength=n)

    whole = np.concatenate([[0], np.cumsum((kind == 5) | (kind == 6) | (kind == 7))])
    signs = whole[ends] - whole[starts]
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    capitals = upper[ends] - upper[starts]
    strange = np.concatenate([[0], np.cumsum(kind == 7)])
    marks = strange[ends] - strange[starts]
    pairs = windows(numbers, 2)
    out = np.zeros((n, len(FEATURES)))
    longest = np.zeros(n)
    np.maximum.at(longest, of_word, length)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    lines = shares[:, 4] + (size > 0)
    distinct, again, top, same_lines = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    raw = data.tobytes()
    for i in range(n):
        a, e = first[i], first[i + 1]
        if e > a:
            count = np.unique(numbers[a:e], return_counts=True)[1]
            distinct[i], top[i] = len(count) / (e - a), count.max() / (e - a)
            again[i] = 1 - len(np.unique(pairs[a : e - 1])) / (e - a - 1) if e - a > 1 else 0
            here = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            same_lines[i] = 1 - len(set(here)) / len(here)
    out[:, 0] = np.log1p(words)
    out[:, 1] = per_text(of_word, length) / w
    out[:, 2] = np.log1p(longest)
    out[:, 3:12] = shares / b[:, None]
    out[:, 12:15] = np.column_stack([distinct, again, same_lines])
    out[:, 15] = np.log1p(words / np.maximum(lines, 1))
    out[:, 16] = np.log1p(words / (1 + shares[:, 5]))
    out[:, 17] = per_text(of_word, (capitals >= 2) & (2 * capitals >= length)) / w
    out[:, 18] = per_text(of_word, signs == length) / w
    out[:, 19] = per_text(of_word, (marks > 0) & (marks < length)) / w
    out[:, 20] = top
    return out


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # inner bin edges of each feature
    constant: float
    tables: np.ndarray  # feature by bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair by bin by bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.constant)
        for k in range(bins.shape[1]):
            out += self.tables[k, bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[bins[:, a], bins[:, b]]
        return out


def _leaf(g, h, ridge=1.0):
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values over the bins of a tree that halves runs of bins where that helps most."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g * _leaf(left_g, left_h) + right_g * _leaf(right_g, right_h)
    at = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts both features once, and the gain of its best cut."""
    sums_g, sums_h = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))

    def corner(s):
        low = s[1:-1, 1:-1]
        row, column, all_ = s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([low, row - low, column - low, all_ - row - column + low])

    quarter_g, quarter_h = corner(sums_g), corner(sums_h)
    gain = (quarter_g * _leaf(quarter_g, quarter_h)).sum(axis=0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = _leaf(quarter_g[:, i, j], quarter_h[:, i, j])
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


def train(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8,
    pair_rounds: int = 60, rate: float = 0.15, depth: int = 2,
) -> AdditiveModel:
    """Cyclic boosting on rows of features and labels 0 or 1."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(
        edges, float(np.log(share / (1 - share))), np.zeros((x.shape[1], bins)), [], np.zeros((0, bins, bins))
    )
    at = model.bins(x)
    margin = np.full(len(y), model.constant)
    for _ in range(rounds):
        for k in range(x.shape[1]):
            p = sigmoid(margin)
            g = np.bincount(at[:, k], y - p, minlength=bins)
            h = np.bincount(at[:, k], p * (1 - p), minlength=bins)
            step = rate * _tree(g, h, depth)
            model.tables[k] += step
            margin += step[at[:, k]]
    p = sigmoid(margin)

    def cells(a, b, values):
        return np.bincount(at[:, a] * bins + at[:, b], values, minlength=bins * bins).reshape(bins, bins)

    gains = {(a, b): _quadrants(cells(a, b, y - p), cells(a, b, p * (1 - p)))[1] for a, b in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda ab: (-gains[ab], ab))[:pairs]
    model.pair_tables = np.zeros((len(model.pairs), bins, bins))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            p = sigmoid(margin)
            step = rate * _quadrants(cells(a, b, y - p), cells(a, b, p * (1 - p)))[0]
            model.pair_tables[k] += step
            margin += step[at[:, a], at[:, b]]
    return model


def learn_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, **options
) -> AdditiveModel:
    """A model from at most ``sample`` labelled rows; without rows it scores everything 0.5."""
    rows = labelled_sample(docs, labels, "quality", learn, sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[:, k]) for k in range(x.shape[1])), part.column("label")], [*FEATURES, "label"]
                )

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label int"
    found = rows.mapInArrow(measure, schema).toPandas().sort_values([*FEATURES, "label"])
    if found.empty:
        n = len(FEATURES)
        return AdditiveModel([np.zeros(0)] * n, 0.0, np.zeros((n, 1)), [], np.zeros((0, 1, 1)))
    return train(found[list(FEATURES)].to_numpy(), (found.label == 1).to_numpy(float), **options)


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows with ``score`` (0 to 1); null counts as empty, other columns are kept."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                score = sigmoid(model.margin(features(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learns from labels whose fold (crc32 of doc_id modulo ``folds``) is not 1; a null
    doc_id has no fold and is not held out.
    """
    model = learn_quality(docs, labels, fold(folds) != 1, **options)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(folds) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
