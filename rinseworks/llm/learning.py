"""What the learned operators share: folds, bounded samples and summed counters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.llm.words import pieces


def fold(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int
) -> DataFrame:
    """At most ``limit`` labels of the learning folds with their texts: ``text, label``.

    The choice is by a hash of the key, so it is the same on every run. The bound makes
    the chosen labels safe to broadcast. Copies of one text with one label count once.
    """
    chosen = (
        labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled"), "labelled", "label").limit(limit)
    )
    return (
        docs.join(F.broadcast(chosen), docs.doc_id == F.col("labelled"))
        .select(F.coalesce(docs.text, F.lit("")).alias("text"), "label")
        .groupBy(F.xxhash64("text").alias("key"), "label").agg(F.first("text").alias("text"))
        .select("text", "label")
    )


def summed(
    docs: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None],
    chunk: int = 1 << 12, limit: int = 1 << 22,
) -> np.ndarray:
    """The sum over all rows of ``size`` counters.

    ``count(rows, counters)`` adds a run of rows to a task's counters. Tasks hand over
    compressed chunks, which are added up by chunk; the driver gets ``size`` numbers.
    """
    chunk = min(chunk, size)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // chunk) * chunk, np.int64)
        for batch in batches:
            for part in pieces(batch, limit=limit):
                count(part, total[:size])
        yield _chunks(enumerate(total.reshape(-1, chunk)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("k").to_pylist(), batch.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + _unpacked(counts)
        yield _chunks(total.items())

    schema = "k int, counts binary"
    out = np.zeros((-(-size // chunk), chunk), np.int64)
    for k, counts in docs.mapInArrow(tally, schema).repartition("k").mapInArrow(add, schema).collect():
        out[k] = _unpacked(counts)
    return out.ravel()[:size]


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64)


def _chunks(items) -> pa.RecordBatch:
    items = list(items)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in items], pa.int32()),
            pa.array([zlib.compress(v.astype(np.int64).tobytes(), 1) for _, v in items], pa.binary()),
        ],
        ["k", "counts"],
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
