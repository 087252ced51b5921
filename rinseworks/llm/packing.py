"""Packing of tokenised documents into windows of a fixed capacity by Karmarkar-Karp
multiway differencing.

A document's ids, closed by a separator id, are cut into full windows; the rest of each
document joins a pool of bounded size. A pool is partitioned into as few windows as its
total needs: the two partial partitions with the largest imbalance are merged with
opposing order, largest sum to smallest, until one partition is left, which makes near-equal
windows. Whenever a window exceeds the capacity the count rises and the pool is
partitioned again.

Rows stay in their input partition: tokenising, cutting and pooling are one pass without a
shuffle, and a lost task is repeated with the same result. Only the last pool of an input
partition is smaller than the others.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.llm.words import pieces

CAPACITY = 1024
POOL = 512
_RUN = 1 << 20
#: The split pattern of the vocabulary. The alternatives begin with different characters,
#: so their order does not matter; letters come first because most pieces are words.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[sdmt]|ll|ve|re)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: str, ranks: str) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level vocabulary file, without added special tokens.

    ``ranks`` is the same vocabulary as merge ranks, which a faster library reads; texts
    that spell out a special token go to the vocabulary file itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def differencing(lengths: np.ndarray, count: int) -> np.ndarray:
    """The window, 0 to ``count`` - 1, of each length; the sums of windows are near equal."""
    m = len(lengths)
    # A node is an item or a pair of nodes that share a window.
    left, right = np.full(2 * m * max(1, count.bit_length()) + m, -1), np.full(2 * m * max(1, count.bit_length()) + m, -1)
    used = m
    heap = []
    for i in range(m):
        sums, nodes = np.zeros(count, np.int64), np.full(count, -1)
        sums[0], nodes[0] = lengths[i], i
        heap.append((-int(sums[0] - sums[-1]), i, sums, nodes))
    heapq.heapify(heap)
    turn = m
    while len(heap) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, _, sums_b, nodes_b = heapq.heappop(heap)
        sums, other = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.where(nodes_a < 0, other, nodes_a)
        both = np.flatnonzero((nodes_a >= 0) & (other >= 0))
        while used + len(both) > len(left):
            left, right = np.append(left, np.full(len(left), -1)), np.append(right, np.full(len(right), -1))
        fresh = np.arange(used, used + len(both))
        left[fresh], right[fresh] = nodes_a[both], other[both]
        nodes[both] = fresh
        used += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), turn, sums, nodes))
        turn += 1
    window = np.full(m, -1)
    for w, node in enumerate(heap[0][3]):
        stack = [int(node)] if node >= 0 else []
        while stack:
            at = stack.pop()
            if at < m:
                window[at] = w
            else:
                stack += [int(left[at]), int(right[at])]
    return window


def fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A window for each length, none over the capacity, and the number of windows."""
    count = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()), 1)
    while True:
        window = differencing(lengths, count)
        sums = np.bincount(window, lengths, minlength=count)
        if sums.max() <= capacity:
            return window, count
        count += max(1, int(np.maximum(sums - capacity, 0).sum() // (2 * capacity)))


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, pool: int = POOL, separator: int = 0
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids
    before the piece, ``offset`` the window's ids before it. A null text is empty and
    consists of its separator. Rows that repeat a doc_id are documents of their own, and a
    null doc_id stays null. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)

        def emptied() -> list[tuple]:
            nonlocal sequence
            window, count = fit(np.array([w[2] for w in waiting], np.int64), capacity)
            filled = np.zeros(count, np.int64)
            out = []
            for at in np.argsort(window, kind="stable"):
                w = window[at]
                out.append((*waiting[at], sequence + int(w), int(filled[w])))
                filled[w] += waiting[at][2]
            sequence += count
            waiting.clear()
            return out

        for batch in batches:
            for part in pieces(batch, limit=_RUN):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), separator], "<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        row = (doc_id, start, len(piece), piece.tobytes(), len(ids))
                        if len(piece) == capacity:
                            rows.append((*row, sequence, 0))
                            sequence += 1
                            continue
                        waiting.append(row)
                        if len(waiting) == pool:
                            rows += emptied()
                yield table(rows)
        if waiting:
            yield table(emptied())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
