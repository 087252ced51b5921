"""Language identification by sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader and temperature calibration.

Character n-grams are runs of code points of the whole text in lower case, hashed into a
fixed number of features. Inverse document frequencies count all rows that may be learned
from. The weights are trained on a bounded sample of these with FTRL-proximal
steps, whose L1 part leaves most weights at zero and whose L2 part keeps the rest small.
Short pieces of texts that training does not see set the temperature: whole texts are so
easy to tell apart that any temperature would do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseworks.frames import durable
from rinseworks.llm.learning import fold, summed
from rinseworks.llm.words import bytes_of, pieces

UNDETERMINED = "und"
BITS = 14
ORDERS = (1, 2, 3)
SAMPLE = 4_000
PIECE = 24
_RUN = 1 << 18


def gram_counts(texts: pa.Array, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and count of every feature that a text has."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, _ = bytes_of(texts)
    low = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    slots = []
    for order in orders:
        if len(low) < order:
            continue
        gram = np.zeros(len(low) - order + 1, np.uint32)
        for k in range(order):
            gram = gram * np.uint32(0x01000193) + low[k : len(low) - order + 1 + k] + np.uint32(order)
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = owner[: len(gram)] == owner[order - 1 :]
        slot = (owner[: len(gram)].astype(np.int64) << bits) | (gram >> np.uint32(32 - bits))
        slots.append(slot[inside])
    # Only what occurs is counted: memory grows with the bytes, whatever the number of texts.
    at, counts = np.unique(np.concatenate(slots or [np.zeros(0, np.int64)]), return_counts=True)
    return at >> bits, at & ((1 << bits) - 1), counts


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature by language
    bias: np.ndarray
    temperature: float
    bits: int = BITS

    def logits(self, texts: pa.Array) -> np.ndarray:
        row, feature, value = weighted(texts, self.idf, self.bits)
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(row, value * self.weights[feature, k], minlength=len(texts)) + self.bias[k]
        return out


def weighted(texts: pa.Array, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and TF-IDF weight; each text's weights have length one."""
    row, feature, count = gram_counts(texts, bits)
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return row, feature, value / np.where(norm > 0, norm, 1)[row]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_features: int, n_labels: int,
    rounds: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: per-coordinate rates, L1 and L2 penalties, one step for each row."""
    z, squares = np.zeros((n_features + 1, n_labels)), np.zeros((n_features + 1, n_labels))

    def weights(at):
        rate = (beta + np.sqrt(squares[at])) / alpha + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / rate)

    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            feature, value = rows[i]
            at, x = np.append(feature, n_features), np.append(value, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1
            slope = x[:, None] * error
            growth = np.sqrt(squares[at] + slope * slope) - np.sqrt(squares[at])
            z[at] += slope - growth / alpha * w
            squares[at] += slope * slope
    w = weights(slice(None))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search on its logarithm.

    One more text than there are is taken to be wrong, so that texts without an error, which
    any low temperature would suit, do not make every score 1.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    doubt = 1 / (n + 2)
    target = np.full((n, k), doubt / (k - 1))
    target[np.arange(n), labels] = 1 - doubt

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn_language(
    docs: DataFrame, label: str, learn: Column, sample: int = SAMPLE, bits: int = BITS, piece: int = PIECE
) -> LanguageModel | None:
    """A model from about ``sample`` rows, spread over the labels; none without labels.

    Only rows for which ``learn`` holds, with text, label and key, are read. Rows are chosen
    by a hash of key and text, the same share of the bound for each label; copies of a row
    count once. A fifth of them is not trained on but calibrates, by pieces of ``piece``
    characters.
    """
    known = docs.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("text", F.col(label).alias("label"), F.xxhash64("doc_id", "text").alias("h"))
    names = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(sample).collect()
    if not names:
        return None
    share = max(1, sample // len(names))
    # The share of each label's hashes that gives about the wanted number of rows.
    cut = F.coalesce(*(F.when(F.col("label") == r[0], F.lit(min(1.0, 1.5 * share / r[1]))) for r in names), F.lit(0.0))
    part = (F.col("h") / 2.0**64 + 0.5) < cut
    checks = F.pmod("h", F.lit(5)) == 0
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - piece + 1, F.lit(1))).cast("int") + 1
    rows = known.where(part).dropDuplicates(["h", "label"]).select(
        F.when(checks, F.substr("text", start, F.lit(piece))).otherwise(F.col("text")).alias("text"), "label", "h", checks.alias("checks")
    )
    rows = durable(rows)

    def count(part: pa.RecordBatch, counters: np.ndarray) -> None:
        _, feature, _ = gram_counts(part.column("text"), bits)
        counters += np.append(np.bincount(feature, minlength=1 << bits), part.num_rows)

    frequency = summed(known.select("text"), (1 << bits) + 1, count, limit=_RUN)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=_RUN):
                row, feature, value = weighted(part.column("text"), idf, bits)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[1:],
                        pa.ListArray.from_arrays(cuts, pa.array(feature.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32))),
                    ],
                    [*part.schema.names[1:], "feature", "value"],
                )

    table = rows.mapInArrow(features, "label string, h long, checks boolean, feature array<int>, value array<float>").orderBy(
        "h", "label"
    ).limit(2 * sample).toArrow()
    languages = sorted({r["label"] for r in table.select(["label"]).to_pylist()})
    code = {v: i for i, v in enumerate(languages)}
    y = np.array([code[v] for v in table.column("label").to_pylist()], np.int64)
    held = table.column("checks").to_numpy()
    data = [
        (np.array(f.values), np.array(v.values, np.float64))
        for f, v in zip(table.column("feature").combine_chunks(), table.column("value").combine_chunks())
    ]
    weights, bias = train([d for d, c in zip(data, held) if not c], y[~held], 1 << bits, len(languages))
    seen = np.array([d[1] @ weights[d[0]] + bias for d, c in zip(data, held) if c]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, calibrate(seen, y[held]), bits)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the calibrated probability.

    A text that is null or has no letter is ``und`` with score 0, as is every text without
    a model. Columns of these names are replaced, others are kept.
    """
    docs = docs.drop("lang_pred", "score")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=_RUN):
                p = softmax(model.logits(part.column("text")) / model.temperature)
                best = p.argmax(axis=1)
                known = np.array(part.column("_lettered"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                        pa.array(np.where(known, p[np.arange(len(best)), best], 0.0)),
                    ],
                    [*part.schema.names[:-1], "lang_pred", "score"],
                )

    schema = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("*", lettered.alias("_lettered")).mapInArrow(run, schema)


def language(docs: DataFrame, folds: int = 3, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text, lang)``.

    Learns from texts and languages whose fold (crc32 of doc_id modulo ``folds``) is not 1.
    """
    model = learn_language(docs.select("doc_id", "text", "lang"), "lang", fold(folds) != 1, **options)
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(folds) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
