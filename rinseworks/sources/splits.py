"""Records that go on over line ends, read from files in splits.

A split of a file can begin anywhere, also inside quotes or inside an object. What it does to the
state it is entered in is found for both states, inside quotes and outside, in one pass over all
splits at once; a pass over one row a split then tells each in which state it really begins.
With that every split cuts its own records, and only the ends that reach into the next
split are put together, file by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a piece does to a state: inside quotes or not -> the same afterwards, and a number that adds up.
Step = Callable[[bytes, bool], tuple[bool, int]]

COMPLETE, ENDS, BEGINS, BETWEEN, BROKEN = range(5)


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, block, value)``: the pieces between separators as bytes, in order within a split."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"),
        F.col("_metadata.file_size").alias("size"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of a batch that come from one split."""
    if not batch.num_rows:
        return
    file = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
    block = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield (batch.column("file")[a].as_py(), int(block[a])), batch.slice(a, b - a)


def split_effects(pieces: DataFrame, step: Step, needs: str = "") -> DataFrame:
    """``(file, block, end0, sum0, end1, sum1, valid, first, bytes, size)`` for each split.

    ``needs`` is a text without which a piece changes nothing; ``first`` the first byte that
    is no space; ``bytes`` those of the pieces, each with a separator; ``size`` the file's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, valid, first, length, size, out = None, [], True, None, 0, 0, []

        def done():
            return (*now, *state[0], *state[1], valid, first or "", length, size)

        for batch in batches:
            for where, rows in _runs(batch):
                if where != now:
                    if now:
                        out.append(done())
                    now, state, valid, first, length = where, [(False, 0), (True, 0)], True, None, 0
                    size = rows.column("size")[0].as_py()
                valid = valid and bool(pc.all(rows.column("valid")).as_py())
                values = rows.column("value")
                length += pc.sum(pc.binary_length(values)).as_py() + len(values)
                if first is None:
                    start = next((v for v in (x.as_py().lstrip(b"\xef\xbb\xbf \t\r\n") for x in values) if v), b"")
                    first = start[:1].decode("latin-1") or None
                if needs:
                    values = values.filter(pc.match_substring(values, needs))
                for value in values.to_pylist():
                    same = state[0] == state[1]
                    state[0] = _after(step, value, state[0])
                    state[1] = state[0] if same else _after(step, value, state[1])
            yield _batch(out, _EFFECT)
            out = []
        if now:
            yield _batch([done()], _EFFECT)

    return pieces.mapInArrow(run, _ddl(_EFFECT))


def _after(step: Step, value: bytes, state: tuple[bool, int]) -> tuple[bool, int]:
    inside, total = state
    inside, change = step(value, inside)
    return inside, total + change


def split_starts(effects: DataFrame) -> DataFrame:
    """``(file, block, inside, total, first, end, sum, bytes, size)``: the state in which each split
    begins, the first byte of its file, and what the split does. A file's rows pass one task,
    a row a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, total, first = None, False, 0, ""
        for batch in batches:
            out = []
            for file, block, end0, sum0, end1, sum1, _, char, *lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    now, inside, total, first = file, False, 0, ""
                first = first or char
                change = (end1, sum1) if inside else (end0, sum0)
                out.append((file, block, inside, total, first, *change, *lengths))
                inside, total = change[0], total + change[1]
            yield _batch(out, _START)

    ordered = effects.repartition("file").sortWithinPartitions("file", "block")
    return ordered.mapInArrow(run, _ddl(_START))


def records(pieces: DataFrame, starts: DataFrame, cutter: Callable, joint: bytes) -> DataFrame:
    """``(file, block, seq, part, value)`` of whole records, and broken ones as they are.

    ``cutter(inside, total, first)`` makes an object for a split whose ``take(piece)`` yields
    ``(part, value)`` and whose ``rest()`` yields what is open at the end. ``starts`` has a row for
    each split and is broadcast; the caller checks how many there are.
    """
    begins = F.broadcast(starts.select("file", "block", "inside", "total", "first"))
    known = pieces.join(begins, ["file", "block"]).select("file", "block", "value", "inside", "total", "first")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, maker = None, 0, None
        for batch in batches:
            out = []
            for where, rows in _runs(batch):
                if where != now:
                    if now:
                        out += [(*now, seq, *r) for r in maker.rest()]
                    now, seq = where, 0
                    maker = cutter(*(rows.column(c)[0].as_py() for c in ("inside", "total", "first")))
                for value in rows.column("value").to_pylist():
                    for found in maker.take(value):
                        out.append((*now, seq, *found))
                        seq += 1
            yield _batch(out, _RECORD)
        if now:
            yield _batch([(*now, seq, *r) for r in maker.rest()], _RECORD)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = [], None
        for batch in batches:
            out = []
            for file, block, seq, part, value in zip(*(c.to_pylist() for c in batch.columns)):
                if held and begun[0] != file:
                    out.append((*begun, COMPLETE, joint.join(held)))
                    held = []
                if not held:
                    begun = (file, block, seq)
                held.append(value)
                if part == ENDS:
                    out.append((*begun, COMPLETE, joint.join(held)))
                    held = []
            yield _batch(out, _RECORD)
        if held:
            yield _batch([(*begun, COMPLETE, joint.join(held))], _RECORD)

    parts = known.mapInArrow(cut, _ddl(_RECORD))
    whole = parts.where(F.col("part").isin(COMPLETE, BROKEN))
    torn = parts.where(F.col("part").isin(ENDS, BEGINS, BETWEEN))  # at most two rows a split
    torn = torn.repartition("file").sortWithinPartitions("file", "block", "seq").mapInArrow(join, _ddl(_RECORD))
    return whole.unionByName(torn)


_EFFECT = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()), ("sum0", pa.int64()), ("end1", pa.bool_()),
    ("sum1", pa.int64()), ("valid", pa.bool_()), ("first", pa.string()), ("bytes", pa.int64()), ("size", pa.int64()),
])
_START = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("total", pa.int64()), ("first", pa.string()),
    ("end", pa.bool_()), ("sum", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()),
])
_RECORD = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("part", pa.int32()), ("value", pa.binary()),
])
_NAMES = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_NAMES[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


# --- delimited text: pieces are lines -------------------------------------------


def quote_step(delimiter: str) -> Step:
    """Whether a line ends inside a quoted field; the number counts the lines that do.

    A quote opens a field where the field begins, and in it is written twice; anywhere else it is data.
    """
    sep = delimiter.encode()

    def step(line: bytes, inside: bool) -> tuple[bool, int]:
        if b'"' not in line:
            return inside, int(inside)
        at = 0
        while True:
            if not inside:
                if line[at : at + 1] != b'"':
                    at = line.find(sep, at) + len(sep)
                    if at < len(sep):
                        return False, 0
                    continue
                at += 1
            while True:
                quote = line.find(b'"', at)
                if quote < 0:
                    return True, 1
                at = quote + 1
                if line[at : at + 1] != b'"':
                    break
                at += 1
            inside = False
            at = line.find(sep, at) + len(sep)
            if at < len(sep):
                return False, 0

    return step


class LineRecords:
    """Puts lines together until one ends outside quotes; blank records are left out."""

    def __init__(self, delimiter: str, inside: bool):
        self.step, self.inside, self.torn, self.lines = quote_step(delimiter), inside, inside, []

    def take(self, line: bytes) -> Iterator[tuple[int, bytes]]:
        self.lines.append(line)
        self.inside, _ = self.step(line, self.inside)
        if not self.inside:
            if self.torn or len(self.lines) > 1 or line.strip():
                yield ENDS if self.torn else COMPLETE, b"\n".join(self.lines)
            self.lines, self.torn = [], False

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.lines:
            yield BETWEEN if self.torn else BEGINS, b"\n".join(self.lines)


# --- objects: pieces end where a brace closes -------------------------------------

_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)


def brace_step(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a string goes on at the piece's end, and by how much brackets open; the brace
    that ends the piece counts unless it is part of a string."""
    if inside:
        end = _STRING_END.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    plain = _STRING.sub(b"", piece) if b'"' in piece else piece
    inside = b'"' in plain
    if inside:
        plain = plain[: plain.index(b'"')]
    return inside, plain.count(b"{") + plain.count(b"[") - plain.count(b"]") - (not inside)


class ObjectRecords:
    """Cuts objects out of an array, or out of a file of objects; anything else is broken."""

    def __init__(self, inside: bool, depth: int, first: str):
        self.base = int(first == "[")
        self.inside, self.depth = inside, depth
        self.torn = self.open = inside or depth > self.base
        self.parts: list[bytes] = []

    def take(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        text = piece
        if not self.open:
            begin = piece.find(b"{")
            between = (piece if begin < 0 else piece[:begin]).strip(b"\xef\xbb\xbf \t\r\n")
            if between not in (b"", b",", b"[", b"]", b"[]"):
                yield BROKEN, piece
            text = piece[begin:] if begin >= 0 else b""
        self.inside, change = brace_step(piece, self.inside)
        self.depth += change
        if self.open or text:
            self.parts.append(text + b"}")
            self.open = self.inside or self.depth > self.base
            if not self.open:
                yield ENDS if self.torn else COMPLETE, b"".join(self.parts)
                self.parts, self.torn = [], False

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            yield BETWEEN if self.torn else BEGINS, b"".join(self.parts)
