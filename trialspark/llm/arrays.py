"""Text columns as flat numpy arrays: bytes, words and word hashes of many texts at once.

Everything works on UTF-8 bytes, so one pass over a batch costs no Python object
per text or word. Hashes are 64 bits wide; two different words or runs of words
of one corpus agree with a chance of about 2^-64 per compared pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of words: all but space and the controls 9 to 13.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each text, its end included; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 2 * len(_powers[kind])), _BASE if kind == "up" else _INVERSE, U64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``data[start:end]`` of each range, from one prefix sum."""
    sums = np.zeros(len(data) + 1, U64)
    weighted = (data.astype(U64) + U64(1)) * _power_table("up", len(data))
    np.cumsum(weighted, out=sums[1:])
    return mix((sums[end] - sums[start]) * _power_table("down", len(data) + 1)[start])


def words(
    data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray = NOT_BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of word bytes; no run crosses texts."""
    inside = of_word[data]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    closes = begins[begins > 0] - 1
    last[closes] = inside[closes]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words, in order.

    A text with fewer words, but not none, has its whole sequence as its one shingle.
    """
    start, end, text = words(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    word = range_hashes(data, start, end)
    counts = np.bincount(text, minlength=n)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    runs = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(n), runs)
    place = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + firsts[of]
    length = np.minimum(counts, size)[of]
    value = length.astype(U64)
    for step in range(size):
        held = step < length
        part = word[np.minimum(place + step, len(word) - 1)]
        value = np.where(held, mix(value ^ part) + U64(step + 1), value)
    return mix(value), of


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys that follow each other, across batch borders; keys are longs without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(key)) for key in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            key = values[:, low].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the least node that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes below ``n`` the least node that it reaches over edges ``a[i], b[i]``."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return label
