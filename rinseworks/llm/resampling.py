"""Importance resampling: a draw of documents whose n-grams resemble a target's.

Words are found and joined into runs of one to three by Arrow kernels on batches of texts.
``split_pattern_regex``, ``list_flatten`` and ``ascii_lower`` give the words of a batch and
``dictionary_encode`` their distinct ones. The index of a run joined with that of the next
word is a pair, dictionary-encoded again; only distinct pairs get a checksum, from the
checksums of their parts, and ``take`` hands it to their places. Sums over stretches of
places give weights.

The corpus is counted in a fixed number of buckets, so the driver gets a few numbers per
bucket whatever the corpus. Ranks come from a range-partitioned sort.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.llm.learning import summed
from rinseworks.llm.words import pieces

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered
_POLYNOMIAL = 0xEDB88320


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts in order, and the word at which each text starts."""
    split = pc.split_pattern_regex(texts.cast(pa.large_string()).fill_null(""), SEPARATOR)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(split)
    real = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    # The words are lowered, not the texts: ascii_lower misreads a slice that was cast.
    return pc.ascii_lower(flat.filter(real)), before[np.concatenate([[0], np.cumsum(lengths)])]


def _shift_tables(steps: int) -> np.ndarray:
    """For each k < ``steps`` what 2**k zero bytes do to each of a checksum's four bytes."""
    one = np.zeros(32, np.uint64)  # images of the 32 bits under a zero byte
    for bit in range(32):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        one[bit] = value

    def apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for bit in range(32):
            out ^= np.where(x >> np.uint64(bit) & np.uint64(1), images[bit], np.uint64(0))
        return out

    tables = np.zeros((steps, 4, 256), np.uint32)
    for k in range(steps):
        for byte in range(4):
            tables[k, byte] = apply(one, np.arange(256, dtype=np.uint64) << np.uint64(8 * byte))
        one = apply(one, one)
    return tables


_SHIFTS = _shift_tables(31)


def joined_checksums(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of the concatenation, from the crc32 of both parts and the right part's bytes."""
    out = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        x = out[on]
        t = _SHIFTS[k]
        out[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out ^ right


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two, ... words: the bucket of each run of the batch, and each text's first run."""
    found, first = words(texts)
    encoded = pc.dictionary_encode(found)
    index, spelled = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    distinct = [w.as_buffer() for w in spelled]
    sums = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    spaced = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in distinct], np.uint32)
    length = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    runs, run_sums, where = index, sums, np.arange(len(index))
    for size in range(1, longest + 1):
        if size > 1:
            # A run goes on with the next word of its text.
            going_on = np.flatnonzero((where + size - 1 < len(index)) & (text[where] == text[np.minimum(where + size - 1, len(index) - 1)]))
            where, pair = where[going_on], runs[going_on] * len(spelled) + index[where[going_on] + size - 1]
            pairs = pc.dictionary_encode(pa.array(pair))
            head, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(spelled)))
            run_sums = joined_checksums(run_sums[head], spaced[last], length[last])
            runs = pairs.indices.to_numpy().astype(np.int64)
        of_place = pc.take(pa.array(run_sums % np.uint32(buckets)), pa.array(runs)).to_numpy()
        yield of_place, np.concatenate([[0], np.cumsum(np.maximum(n_words - size + 1, 0))])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many runs of all texts fall in each bucket."""

    def count(rows: pa.RecordBatch, counters: np.ndarray) -> None:
        for of_place, _ in features(rows.column("text"), buckets, longest):
            counters += np.bincount(of_place, minlength=buckets)

    return summed(texts.select(F.col("text").cast("string")), buckets, count)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm, in thousandths, of how much likelier a bucket is in the target."""
    n = len(corpus)
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n))))
        for a, b in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """A Gumbel number in thousandths that depends on the key alone; a null key is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``.

    ``rank`` counts from 1 along the drawn rows and is null for the others; of N rows with at
    least ``least_words`` words, ``floor(percent * N / 100)`` are drawn by score, ties to the
    smaller doc_id, a null one last, then to more features. A null or empty text has no
    features and weight 0. Rows that repeat a doc_id share its noise and are drawn each for
    itself. An empty target leaves the corpus's own counts; an empty ``docs`` gives no rows.
    Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                n = np.zeros(part.num_rows, np.int64)
                weight, n_words = n.copy(), None
                for of_place, first in features(part.column("text"), buckets, longest):
                    n_words = np.diff(first) if n_words is None else n_words
                    n += np.diff(first)
                    weight += np.diff(np.concatenate([[0], np.cumsum(gain[of_place])])[first])
                drawn = np.array([noise(k, seed) for k in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight + drawn), pa.array(n_words >= least_words)],
                    ["doc_id", "n_features", "weight", "score", "eligible"],
                )

    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    scored = durable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        weigh, "doc_id long, n_features long, weight long, score long, eligible boolean"
    ))
    placed = durable(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("e"))
    offsets = counts.select(  # one row for each partition of the sort
        "part", F.expr("sum(n) over (order by part) - n").alias("before"),
        F.expr(f"sum(e) over () * {percent} div 100").alias("draws"),
    )
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank)
    return ranked.select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("draws"), F.col("rank")).alias("rank")
    )
