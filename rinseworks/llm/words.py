"""Words of whole texts as numbers, for the operators that compare word sequences.

Everything works on one Arrow batch of texts at a time, as a few passes over its bytes.
A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, so words are the same whatever the text's encoding of other characters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xD6E8FEB86659FD93)
#: Sums of powers tell words of up to so many bytes apart; of longer ones whole patterns coincide
#: modulo 2**64, so these are hashed one by one.
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _letters(lower: bool, seed: int) -> np.ndarray:
    """A 64-bit value per byte; with ``lower`` A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE + 2 * seed))
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2**64, and their inverses."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        size = 1 << int(max(n, 2) - 1).bit_length()
        _powers[seed] = []
        for base in (_BASES[seed], pow(_BASES[seed], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[seed].append(np.multiply.accumulate(steps))
    return _powers[seed][0][:n], _powers[seed][1][:n]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The batch's UTF-8 bytes and the offset of each text in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and end of each word in them, and the word at which each text starts."""
    data, offsets = bytes_of(texts)
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SEPARATOR[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    going_on = inside[1:].copy()
    going_on[offsets[offsets > 0] - 1] = False  # a text's last byte ends its word
    ends = np.flatnonzero(inside[:-1] & ~going_on) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_numbers(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number per word, equal for equal words, and each text's first word.

    Numbers of seeds 0 and 1 are independent of each other.
    """
    data, starts, ends, first = split(texts)
    up, down = powers(len(data) + 1, seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(lower, seed)[data] * up[:-1], out=sums[1:])
    numbers = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > _SHORT):
        word = data[starts[i] : ends[i]]
        if lower:
            word = np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8)
        numbers[i] = xxhash.xxh3_64_intdigest(word.tobytes(), seed)
    return numbers, first


def windows(numbers: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit number for each run of ``size`` words; runs may cross texts."""
    n = max(0, len(numbers) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        factor = int(mix(np.array([(k + 1) * 2 + 1000003 * (seed + 1)], np.uint64))[0]) | 1
        total += numbers[k : k + n] * np.uint64(factor)
    return mix(total)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 22):
    """Cut a batch into runs of rows with about ``limit`` bytes of text each, so that the
    arrays made for a run stay small whatever the batch size; a longer text is alone."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def signed(x: np.ndarray) -> pa.Array:
    """Spark has no unsigned 64-bit type."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
