"""Records of delimited text whose quoted fields hold line ends, read by many tasks per file.

Whether a line end ends a record depends on every quote before it. Files are therefore cut
into byte blocks. A first pass works out, for each block by itself, how it is left when
entered outside quotes and when entered inside quotes. Chaining these small tables from
block to block tells how each block is really entered, and then each block gives the
records that start in it, reading on beyond its end to finish the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.sources.files import CHUNK, resolve

BLOCK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
OUTSIDE, INSIDE = 0, 1

_ENTERED = "path string, begin long, end long, entry int"
_LEFT = "path string, begin long, end long, from_outside int, from_inside int, n_lines long"


@dataclass(frozen=True)
class Marks:
    """How fields are written, and whether characters take two bytes."""

    sep: str
    quote: str
    escape: str
    wide: bool


@dataclass(frozen=True)
class Blocks:
    """Byte blocks of all parts of a file with the state in which each is entered."""

    rows: tuple[tuple[str, int, int, int], ...]
    marks: Marks


class _Lines:
    """Tells how a line is left; lines come without their line end."""

    def __init__(self, marks: Marks) -> None:
        q, s, e = (re.escape(mark) for mark in (marks.quote, marks.sep, marks.escape))
        inner = rf"(?:[^{q}]++|{q}{q})*+" if marks.quote == marks.escape else rf"(?:[^{q}{e}]++|{e}[{q}{e}]|{e})*+"
        # What follows a closed quote up to the separator belongs to the field, quotes included.
        fields = rf"(?:(?:{q}{inner}{q}[^{s}]*+|[^{q}{s}][^{s}]*+)?+{s})*+"
        opened = rf"{fields}{q}{inner}"
        self._opened = re.compile(opened.encode("latin-1"), re.DOTALL)
        self._still = re.compile(rf"{inner}(?:{q}[^{s}]*+{s}{opened})?+".encode("latin-1"), re.DOTALL)

    def left(self, line: bytes, state: int) -> int:
        pattern = self._still if state == INSIDE else self._opened
        return INSIDE if pattern.fullmatch(line) else OUTSIDE


def _narrow(data: bytes, wide: bool) -> bytes:
    """One byte per UTF-16 unit: marks keep their code, units beyond 255 become one that is no mark."""
    if not wide:
        return data
    units = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    return np.where(units < 256, units, 255).astype(np.uint8).tobytes()


class _Block:
    """The lines that start in a block of a file, and more lines behind it on demand."""

    def __init__(self, path: str, begin: int, end: int, marks: Marks) -> None:
        system, at = resolve(path)
        self._file = system.open_input_file(at)
        self._size, self._width = self._file.size(), 2 if marks.wide else 1
        self._wide = marks.wide
        # One unit before the block tells whether a line starts right at its begin.
        self._from = max(0, begin - self._width)
        self.data = self._file.read_at(end - self._from, self._from)
        self.codes = _narrow(self.data, self._wide)
        ends = np.flatnonzero(np.frombuffer(self.codes, np.uint8) == 10)
        first = 0
        if begin:
            first = int(ends[0]) + 1 if len(ends) else len(self.codes)
        n_owned = len(self.codes)
        self.starts = np.concatenate(([first] if first < n_owned else [], ends[ends >= first] + 1)).astype(np.int64)
        self.starts = self.starts[self.starts < n_owned]
        self.ends = ends[ends >= first]
        if len(self.ends) < len(self.starts):
            self.ends = np.append(self.ends, self.more(n_owned))

    def more(self, begin: int) -> int:
        """End of the line that is under way at ``begin``, reading on as far as needed."""
        while True:
            end = self.codes.find(b"\n", begin)
            if end >= 0:
                return end
            begin = len(self.codes)
            at = self._from + len(self.data)
            if at >= self._size:
                return len(self.codes)
            piece = self._file.read_at(min(CHUNK, self._size - at), at)
            self.data += piece
            self.codes = self.codes + _narrow(piece, self._wide) if self._wide else self.data

    def text(self, begin: int, end: int) -> bytes:
        return self.data[begin * self._width : end * self._width]

    def close(self) -> None:
        self._file.close()


def _states(marks: Marks):
    """How each block is left, for both ways to enter it."""
    quote = marks.quote.encode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _Lines(marks)
        for batch in batches:
            for path, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = _Block(path, begin, end, marks)
                state, places = [OUTSIDE, INSIDE], _with_quote(block, quote)
                for i in places.tolist():
                    line = block.codes[block.starts[i] : block.ends[i]]
                    left = {s: lines.left(line, s) for s in set(state)}
                    state = [left[s] for s in state]
                # The last line of a file need not end.
                n_ended = int((block.ends < len(block.codes)).sum())
                block.close()
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "path": path,
                            "begin": begin,
                            "end": end,
                            "from_outside": state[OUTSIDE],
                            "from_inside": state[INSIDE],
                            "n_lines": n_ended,
                        }
                    ],
                    schema=pa.schema(
                        [
                            ("path", pa.string()),
                            ("begin", pa.int64()),
                            ("end", pa.int64()),
                            ("from_outside", pa.int32()),
                            ("from_inside", pa.int32()),
                            ("n_lines", pa.int64()),
                        ]
                    ),
                )

    return run


def _with_quote(block: _Block, quote: bytes) -> np.ndarray:
    """Numbers of the lines that hold a quote: only these can change the state."""
    quotes = np.flatnonzero(np.frombuffer(block.codes, np.uint8) == quote[0])
    at = np.unique(np.searchsorted(block.starts, quotes, "right") - 1)
    return at[at >= 0]


def _records_of(marks: Marks, header: bool):
    quote = marks.quote.encode("latin-1")
    encoding = "utf-16-le" if marks.wide else "utf-8"

    def spans(block: _Block, entry: int) -> Iterator[tuple[int, int]]:
        """Begin and end of the records that start in the block."""
        lines, state, opened = _Lines(marks), entry, None
        quoted = set(_with_quote(block, quote).tolist())
        for i, (begin, end) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
            if state == OUTSIDE:
                opened = begin
            if i in quoted:
                state = lines.left(block.codes[begin:end], state)
            if state == OUTSIDE and opened is not None:
                yield opened, end
        while state == INSIDE and opened is not None:
            begin = end + 1
            if begin >= len(block.codes):
                end = block.more(begin)
                if begin >= len(block.codes):
                    # A quote that is never closed: the rest of the file is its record.
                    yield opened, len(block.codes)
                    return
            end = block.more(begin)
            state = lines.left(block.codes[begin:end], state)
            if state == OUTSIDE:
                yield opened, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end, entry in zip(*(batch.column(i).to_pylist() for i in range(4))):
                block = _Block(path, begin, end, marks)
                held, size, skip = [], 0, header and begin == 0
                for low, high in spans(block, entry):
                    raw = block.text(low, high)
                    record = raw.decode(encoding, "replace").removesuffix("\r")
                    if not begin and not low:
                        record = record.lstrip("\ufeff")
                    if not record:
                        continue
                    if skip:
                        skip = False
                        continue
                    held.append(record)
                    size += len(raw)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
                        held, size = [], 0
                block.close()
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])

    return run


def _tasks(spark: SparkSession, n_blocks: int) -> int:
    return max(1, min(n_blocks, 1 << 14))


def find_blocks(spark: SparkSession, source: str, marks: Marks) -> Blocks | None:
    """Blocks of a file, or of a folder of part files (a literal path), with their entry states.

    None where executors can't read ranges of bytes (a store that Arrow doesn't know), and
    for files whose lines end in carriage returns alone.
    """
    files = spark.read.format("binaryFile").load(source).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK_BYTES).cast("long"))
    cut = files.select("path", F.explode(starts).alias("begin"), "length").select(
        "path", "begin", F.least(F.col("begin") + BLOCK_BYTES, "length").alias("end")
    )
    rows = sorted(tuple(row) for row in cut.collect())
    try:
        if rows:
            resolve(rows[0][0])
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return None
    if not rows:
        return Blocks((), marks)
    blocks = spark.createDataFrame(rows, "path string, begin long, end long").repartition(_tasks(spark, len(rows)))
    found = sorted(tuple(row) for row in blocks.mapInArrow(_states(marks), _LEFT).collect())
    if not sum(row[5] for row in found) and any(row[2] > CHUNK or _bare_returns(row[0]) for row in found):
        return None
    entered, state, last = [], OUTSIDE, None
    for path, begin, end, from_outside, from_inside, _ in found:
        if path != last:
            state, last = OUTSIDE, path
        entered.append((path, begin, end, state))
        state = from_inside if state == INSIDE else from_outside
    return Blocks(tuple(entered), marks)


def _bare_returns(path: str) -> bool:
    system, at = resolve(path)
    with system.open_input_file(at) as file:
        return b"\r" in file.read(CHUNK)


def quoted_records(spark: SparkSession, blocks: Blocks, header: bool) -> DataFrame:
    """``(line)``: every record as text, line ends inside quotes kept; empty ones are left out.

    ``header`` leaves out the first record of each part file.
    """
    if not blocks.rows:
        return spark.createDataFrame([], "line string")
    rows = spark.createDataFrame(list(blocks.rows), _ENTERED)
    # An explicit number of tasks: the rows are few bytes but much work.
    dealt = rows.repartitionByRange(_tasks(spark, len(blocks.rows)), "path", "begin")
    return dealt.mapInArrow(_records_of(blocks.marks, header), "line string")
