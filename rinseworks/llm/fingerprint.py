"""Fingerprints of texts from their improbable byte windows, as chained Bloom filters.

Every window of 64 bytes has an entropy. How rare a class of entropy is, counted over all
documents, ranks the window; of each run of 64 neighbouring windows the rarest one, the
first on ties, gains a point, and windows with enough points are the text's features.
Their hashes go, in text order, into Bloom filters of 2,048 bits, a new one after every
160 features. Likeness is the overlap of set bits beyond what chance gives, as a share of
the most that is possible, for each filter of the shorter chain with its best match.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.llm.learning import summed
from rinseworks.llm.words import bytes_of, mix, pieces, powers

WINDOW = 64
RUN = 64
POINTS = 16
CLASSES = 256
FILTER_BITS = 2048
FILTER_FEATURES = 160
_HASHES = 5
_LIMIT = 1 << 19
_SCALE = 1 << 12
_G = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 2)], np.int64)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class, 0 to 255, of each window of a run of bytes.

    A window's sum of c * log2(c) over its byte counts changes, from one window to the
    next, only by the byte that leaves and the one that enters. How often these are in the
    window is read off the positions of equal bytes, sorted together.
    """
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint8)
    order = np.argsort(data, kind="stable")
    keys = (data[order].astype(np.int64) << 40) + order
    at = np.arange(len(data))
    ahead, behind = np.empty(len(data), np.int16), np.empty(len(data), np.int16)
    ahead[order] = np.searchsorted(keys, keys + WINDOW) - at
    behind[order] = at - np.searchsorted(keys, keys - WINDOW + 1) + 1
    first = _G[np.bincount(data[:WINDOW])].sum()
    change = np.zeros(n, np.int64)
    if n > 1:
        leaving, entering = ahead[: n - 1], behind[WINDOW:]
        change[1:] = _G[leaving - 1] - _G[leaving] + _G[entering] - _G[entering - 1]
    sums = first + np.cumsum(change)
    most = int(_G[WINDOW])
    return ((most - sums) * CLASSES // (most + 1)).astype(np.uint8)


def rarity(histogram: np.ndarray, lowest: int = CLASSES // 10) -> np.ndarray:
    """The rank of each entropy class, the rarest first; nearly uniform windows rank last
    and never become features."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), histogram))] = np.arange(CLASSES)
    rank[:lowest] = CLASSES
    return rank


def chains(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each text its filters: number of features and bits."""
    n = len(data) - WINDOW + 1
    hashes = np.zeros(0, np.uint64)
    picked = np.zeros(0, np.int64)
    if n > 0:
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:-1], out=sums[1:])
        ranks = rank[entropy_classes(data)]
        key = (ranks << 40) + np.arange(n)
        for k in (1, 2, 4, 8, 16, 32):
            key = np.minimum(key[: len(key) - k], key[k:]) if len(key) > k else key
        winners = np.zeros(n, np.int64)
        low, high = offsets[:-1], offsets[1:] - WINDOW  # first and last window of each text
        full = high - low + 1 >= RUN
        if full.any():
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, low[full], 1)
            np.add.at(inside, high[full] - RUN + 2, -1)
            starts = np.flatnonzero(np.cumsum(inside)[:-1])
            won = key[starts]
            winners = np.bincount(won[won < (CLASSES << 40)] & ((1 << 40) - 1), minlength=n)
        for a, b in zip(low[~full], high[~full]):
            if b >= a:  # fewer windows than a run: one pick
                best = a + int(ranks[a : b + 1].argmin())
                if ranks[best] < CLASSES:
                    winners[best] = POINTS
        picked = np.flatnonzero(winners >= POINTS)
        hashes = mix((sums[picked + WINDOW] - sums[picked]) * down[picked])
    cuts = np.searchsorted(picked, offsets)
    out = []
    for i in range(len(offsets) - 1):
        mine = hashes[cuts[i] : cuts[i + 1]]
        if not len(mine) and offsets[i + 1] > offsets[i]:  # no feature: the text as a whole
            digest = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest()
            mine = np.frombuffer(digest, np.uint64)
        out.append([_filter(mine[k : k + FILTER_FEATURES]) for k in range(0, len(mine), FILTER_FEATURES)])
    return out


def _filter(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    bits = np.zeros(FILTER_BITS, bool)
    for k in range(_HASHES):
        bits[(hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return len(hashes), bits


def written(chain: list[tuple[int, np.ndarray]]) -> str:
    """The chain as text: for each filter its number of features and its bits in base 64."""
    return ".".join(f"{n:02x}{base64.b64encode(np.packbits(bits)).decode()}" for n, bits in chain)


def read(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    return [
        (int(part[:2], 16), np.unpackbits(np.frombuffer(base64.b64decode(part[2:]), np.uint8)).astype(bool))
        for part in fingerprint.split(".") if part
    ]


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """0 to 1; two empty chains are alike, an empty and another one are not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.array([f[1] for f in c], np.float32) for c in (a, b))
    sizes_x, sizes_y = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    most, chance = np.minimum(sizes_x, sizes_y), sizes_x * sizes_y / FILTER_BITS
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0, 1).max(axis=1)
    return float(np.average(score, weights=[f[0] for f in a]))


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """How often each entropy class occurs, over all windows of all texts."""

    def count(rows: pa.RecordBatch, counters: np.ndarray) -> None:
        data, offsets = bytes_of(rows.column("text"))
        classes = entropy_classes(data)
        if not len(classes):
            return
        inside = np.zeros(len(data) + 1, np.int64)
        long = offsets[1:] - offsets[:-1] >= WINDOW
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - WINDOW + 1, -1)
        counters += np.bincount(classes[np.cumsum(inside)[: len(classes)] > 0], minlength=CLASSES)

    return summed(docs.select("text"), CLASSES, count, limit=_LIMIT)


def fingerprint_with_next(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)``, of the text edited by its
    successor, and their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The successor is the next document by doc_id, after the last the first;
    rows that repeat a doc_id follow each other by text, and a null doc_id comes before
    all others. Editing replaces the last floor(n_chars / 2) characters by as many of the
    successor's first, or all it has. A null text is empty. Other columns are ignored; an
    empty table gives no rows.

    Documents go once to runs of neighbouring keys; the first of each run also goes to the
    run before it. ``runs`` is four for each shuffle partition unless given; its bounds and
    first keys are what the driver holds.
    """
    spark = docs.sparkSession
    rank = rarity(entropy_histogram(docs))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
    )
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.agg(F.percentile_approx("key", [k / runs for k in range(1, runs)] or [0.5], 4 * runs)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def run_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), "right").astype(np.int32))

    firsts = dict(keyed.select(run_of("key").alias("run"), "key").groupBy("run").agg(F.min("key")).collect())
    order = sorted(firsts)
    # The first key of each run, and the run that needs it as the successor of its last row.
    before = [(firsts[r], order[i - 1]) for i, r in enumerate(order)]

    first_keys = np.array([k for k, _ in before], np.int64)
    runs_before = np.array([r for _, r in before], np.int32)

    @F.pandas_udf("int")
    def run_before(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(first_keys, k), max(0, len(first_keys) - 1))
        return pd.Series(np.where(first_keys[at] == k, runs_before[at], -1).astype(np.int32))

    sent = keyed.select("*", F.array(
        F.struct(run_of("key").alias("run"), F.lit(0).alias("extra")),
        F.struct(run_before("key").alias("run"), F.lit(1).alias("extra")),
    ).alias("to")).select("doc_id", "key", "text", F.inline("to")).where("run >= 0")
    dealt = sent.repartition("run").sortWithinPartitions("run", "extra", "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far and its chain
        for batch in batches:
            for part in pieces(batch, limit=_LIMIT):
                table = part.select(["run", "extra", "doc_id", "text"])
                rows = list(zip(*(table.column(k).to_pylist() for k in range(4))))
                own = chains(*bytes_of(part.column("text")), rank)
                if held:
                    rows, own = [held[0], *rows], [held[1], *own]
                pairs = [
                    i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]
                ]
                edited = [_edited(rows[i][3], rows[i + 1][3]) for i in pairs]
                theirs = chains(*bytes_of(pa.array(edited, pa.string())), rank)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][2] for i in pairs], pa.int64()),
                        pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([written(own[i]) for i in pairs], pa.string()),
                        pa.array([written(c) for c in theirs], pa.string()),
                        pa.array([likeness(own[i], c) for i, c in zip(pairs, theirs)], pa.float64()),
                        pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
                    ],
                    _COLUMNS,
                )
                held = rows[-1], own[-1]

    kinds = "long", "long", "string", "string", "string", "double", "double"
    return dealt.mapInArrow(compare, ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS, kinds)))


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited(text: str, successor: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]
