"""Repeated passages found by recompression.

A text is a sequence of words. In each round, neighbouring symbols join into one: runs of
one symbol, and pairs whose first symbol is of the left and whose second is of the right
half of the alphabet. A symbol's name is a fingerprint of what it spells and its half is a
bit of that name, so all tasks name alike and equal passages get the same symbols, but for
a margin at both ends. How far a symbol depends on its surroundings is carried along: a
symbol whose surroundings lie within a window of words occurs in every other occurrence of
that window.

Of the symbols that lie in a window with their surroundings, the one of the highest round
with the smallest name stands for the window. Two windows of equal words have the same
symbol, so only symbols that occur twice are looked at further: the windows they stand for
are compared by 128-bit fingerprints of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseworks.frames import durable
from rinseworks.llm.words import mix, pieces, powers, signed, split, word_numbers

WINDOW = 35
ROUNDS = 3
BROADCAST_ROWS = 500_000
#: Bytes of text that a task works on at a time; its arrays take about a hundred times as much.
RUN = 1 << 20


def recompressed(numbers: np.ndarray, first: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round the symbols' names and the words, first and last, they depend on.

    A dependency on the text's begin or end reaches one word beyond it.
    """
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    low, high = np.repeat(first[:-1] - 1, count), np.repeat(first[1:], count)  # beyond the text
    name, left, right = numbers.copy(), np.arange(len(numbers)), np.arange(len(numbers))
    for r in range(rounds):
        half = (name >> np.uint64(r)) & np.uint64(1)
        together = (owner[1:] == owner[:-1]) & ((name[1:] == name[:-1]) | ((half[:-1] == 0) & (half[1:] == 1)))
        heads = np.flatnonzero(np.concatenate([[True], ~together])) if len(name) else np.zeros(0, np.int64)
        tails = np.append(heads[1:], len(name)) - 1 if len(name) else heads
        # Spelling: a polynomial over the names of the parts.
        up, down = powers(len(name) + 1)
        sums = np.zeros(len(name) + 1, np.uint64)
        np.cumsum(name * up[:-1], out=sums[1:])
        spelled = mix((sums[tails + 1] - sums[heads]) * down[heads] + np.uint64(0x9E37 * (r + 1)))
        # A symbol also depends on the neighbours that did not join it.
        before, after = np.maximum(heads - 1, 0), np.minimum(tails + 1, max(0, len(name) - 1))
        inner_left = (heads > 0) & (owner[before] == owner[heads])
        inner_right = (tails < len(name) - 1) & (owner[after] == owner[tails])
        new_left = np.where(inner_left, left[before], low[heads])
        new_right = np.where(inner_right, right[after], high[tails])
        name, left, right = spelled, new_left, new_right
        owner, low, high = owner[heads], low[heads], high[heads]
        yield name, left, right


def standing(numbers: np.ndarray, first: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a text its first word, the fingerprint of what its symbol depends
    on, and the first word of that; a window without such a symbol stands for itself."""
    n = len(numbers)
    starts = np.concatenate(
        [np.arange(a, b - window + 1) for a, b in zip(first[:-1], first[1:]) if b - a >= window] or [np.zeros(0, np.int64)]
    )
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers * up[:n], out=sums[1:])
    key = mix((sums[starts + window] - sums[starts]) * down[starts])
    place = starts.copy()
    open_ = np.ones(len(starts), bool)
    for name, left, right in reversed(list(recompressed(numbers, first, rounds))):
        at = np.flatnonzero(open_)
        lo = np.searchsorted(left, starts[at])
        hi = np.searchsorted(right, starts[at] + window - 1, "right")  # symbols lo to hi - 1 lie inside
        inside = hi > lo
        at, lo, hi = at[inside], lo[inside], hi[inside]
        if not len(at):
            continue
        best, span = name, 1
        tables = [name]
        while 2 * span <= int((hi - lo).max()):
            best = np.minimum(best[: len(best) - span], best[span:])
            tables.append(best)
            span *= 2
        level = np.floor(np.log2(hi - lo)).astype(np.int64)
        least = np.zeros(len(at), np.uint64)
        for k, table in enumerate(tables):
            mine = level == k
            least[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k)])
        # Which of them it is: the first with the smallest name.
        pick, searching = lo.copy(), name[lo] != least
        while searching.any():
            pick[searching] += 1
            searching = name[pick] != least
        a, b = left[pick], right[pick] + 1
        key[at] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x51_7CC1B7))
        place[at], open_[at] = a, False
    return starts, key, place


def window_prints(numbers: tuple[np.ndarray, np.ndarray], starts: np.ndarray, window: int) -> list[np.ndarray]:
    """64-bit fingerprints of the windows that begin at ``starts``, one from each of two
    independent numberings of the words."""
    out = []
    for seed, values in enumerate(numbers):
        up, down = powers(len(values) + 1, seed)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        out.append(mix((sums[starts + window] - sums[starts]) * down[starts]))
    return out


def _entry(words: list[bytes]) -> bytes:
    """128 bits that name a text by its words."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs(doc_id, text)``.

    A word is removed if a window of ``window`` words that covers it also begins anywhere
    else in the input. ``with_text`` adds ``kept_text``, the kept words joined by blanks,
    null where nothing is removed. A null or empty text has no words and texts shorter
    than a window keep all. Repeated rows repeat each other's windows; a null doc_id is a
    key like others. An empty table gives no rows. Other columns are ignored.

    Texts of the same words are one entry from the start: all their windows are repeated.
    Entries are named by 128 bits of SHA-256, windows by two independent fingerprints.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=RUN):
                numbers, first = word_numbers(part.column("text"))
                starts, key, place = standing(numbers, first, window, rounds)
                keys, counts, again = [], [], []
                cuts = np.searchsorted(starts, first)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    symbol = mix(place[a:b].astype(np.uint64)) + key[a:b]
                    at = np.unique(symbol, return_index=True)[1] + a  # one row for each symbol and place
                    mine, times = np.unique(key[at], return_counts=True)
                    order = np.argsort(-times, kind="stable")
                    keys.append(mine[order])
                    counts.append(len(mine))
                    again.append(int((times > 1).sum()))
                whole = [hashlib.sha256(b" ".join((t or "").encode().split())) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("hash"),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array([h.digest()[:16] for h in whole], pa.binary()),
                        pa.array([h.hexdigest() for h in whole], pa.string()),
                        pa.ListArray.from_arrays(
                            np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), signed(np.concatenate(keys))
                        ),
                        pa.array(again, pa.int32()),
                    ],
                    ["doc_id", "hash", "n_words", "entry", "whole", "keys", "again"],
                )

    marked = durable(docs.mapInArrow(
        mark, "doc_id long, hash long, n_words long, entry binary, whole string, keys array<long>, again int"
    ))
    # Half of a name is enough to ask whether two texts share a symbol, and there are many symbols.
    symbols = marked.select(F.xxhash64("entry").alias("half"), F.posexplode("keys").alias("at", "key"), "again").select(
        "half", "key", (F.col("at") < F.col("again")).alias("again")
    )
    shared = symbols.groupBy("key").agg(F.min("half").alias("a"), F.max("half").alias("b"), F.max("again").alias("again"))
    shared = durable(shared.where("a <> b or again").select("key"))
    small = shared.count() <= broadcast_rows
    hits = symbols.join(F.broadcast(shared) if small else shared, "key").select("half", "key").distinct()
    hits = hits.groupBy("half").agg(F.collect_list("key").alias("keys"))  # at most a text's own symbols
    classes = marked.groupBy("entry").agg(F.min(F.struct("doc_id", "hash")).alias("k"), F.count("*").alias("copies"))
    classes = classes.select("entry", F.col("k.doc_id").alias("id"), F.col("k.hash").alias("of"), "copies")
    suspects = durable(hits.join(classes.withColumn("half", F.xxhash64("entry")), "half"))
    copies = classes.where("copies > 1")

    def with_texts(frame: DataFrame, load: str) -> DataFrame:
        """The frame's rows with the text of their entry; ``load`` measures a row."""
        rows, total = frame.agg(F.count("*"), F.sum(F.expr(load))).first()
        side = F.broadcast(frame) if rows <= broadcast_rows and (total or 0) <= 4 * broadcast_rows else frame
        return docs.join(side, docs.doc_id.eqNullSafe(side["id"]) & (docs["hash"] == side["of"])).drop("doc_id", "id", "hash", "of")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=RUN):
                numbers, first = word_numbers(part.column("text"))
                starts, key, _ = standing(numbers, first, window, rounds)
                cuts = np.searchsorted(starts, first)
                entries, wanted = part.column("entry").to_pylist(), part.column("keys")
                texts = part.column("text").to_pylist()
                chosen, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, entry in enumerate(entries):
                    if _entry((texts[i] or "").encode().split()) == entry:
                        mine = np.array(wanted[i].values, np.int64).view(np.uint64)
                        at = np.flatnonzero(np.isin(key[cuts[i] : cuts[i + 1]], mine)) + cuts[i]
                        chosen.append(at)
                        owner.append(np.full(len(at), i))
                at, owner = starts[np.concatenate(chosen)], np.concatenate(owner)
                a, b = window_prints((numbers, word_numbers(part.column("text"), seed=1)[0]), at, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("entry").take(pa.array(owner)), pa.array((at - first[owner]).astype(np.int32)),
                        signed(a), signed(b), part.column("many").take(pa.array(owner)),
                    ],
                    ["entry", "at", "a", "b", "many"],
                )

    suspects = suspects.select("id", "of", "entry", "keys", (F.col("copies") > 1).alias("many"))
    found = durable(with_texts(suspects, "size(keys)").mapInArrow(
        compare, "entry binary, at int, a long, b long, many boolean"
    ))
    twice = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("many").alias("many"))
    twice = durable(twice.where("n > 1 or many").select("a", "b"))  # written, so that the join can split a hot window
    covered = found.where("not many").join(twice, ["a", "b"], "left_semi")
    covered = covered.groupBy("entry").agg(F.collect_list("at").alias("at"))  # at most a text's own windows

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at"):
                at = np.unique(np.array(at.values))
                cut = np.flatnonzero(np.diff(at) > window) + 1
                heads, tails = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + window
                out.append(np.column_stack([heads, tails]).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry"), pa.array(out, pa.list_(pa.int32()))], ["entry", "runs"]
            )

    covered = covered.mapInArrow(runs, "entry binary, runs array<int>")
    covered = durable(covered.join(classes, "entry").select("id", "of", "entry", "runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=RUN):
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    entry = part.column("entry")[i].as_py()
                    words, kept, last = (text or "").encode().split(), [], 0
                    if _entry(words) != entry:
                        continue
                    ends = part.column("runs")[i].as_py()
                    for a, b in zip(ends[::2], ends[1::2]):
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    rows.append((entry, len(words) - len(kept), _sha(kept), b" ".join(kept).decode() if with_text else None))
                columns = list(zip(*rows)) or [()] * 4
                kinds = pa.binary(), pa.int64(), pa.string(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["entry", "n_removed", "kept", "kept_text"])

    partly = with_texts(covered, "size(runs)").mapInArrow(cut, "entry binary, n_removed long, kept string, kept_text string")
    partly = partly.groupBy("entry").agg(*(F.first(c).alias(c) for c in ("n_removed", "kept", "kept_text")))
    wholly = copies.select("entry", F.lit(None).cast("long").alias("n_removed"), F.lit(_sha([])).alias("kept"), F.lit("").alias("kept_text"))
    outcome = partly.unionByName(wholly)
    out = marked.select("doc_id", "n_words", "entry", "whole").join(outcome, "entry", "left")
    changed = F.col("kept").isNotNull() & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words",
        F.when(changed, F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(changed, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
        *([F.when(changed, F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
