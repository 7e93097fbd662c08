"""Removal of byte strings that an earlier document already has, by sparse suffix arrays.

Of every 50-byte window the 20-byte string with the least hash is its anchor, so equal
windows have equal anchors and only the suffixes that begin at anchors (about one in
sixteen) need to be compared. No window is skipped.

1. Documents are dealt by a hash of their id into cells of about 8 MB.
2. Cells send the distinct 64-bit hashes of their anchors, with the number of contexts each
   has, to hash ranges, which answer with two bits each: does another document have this
   anchor, and does it stand in very many contexts?
3. For shared anchors the cells send the suffix (50 bytes from the anchor on) and the
   bytes before it to range partitions. Sampled splitters over the leading eight bytes
   bound the ranges. A leading word that several splitters have is cut by a hash of the
   anchor into as many ranges, and without any splitter all ranges are cut by that hash;
   equal anchors meet in any case. An anchor in very many contexts is sent window by
   window instead, each dealt by a hash of its 50 bytes, so that only equal windows meet.
4. Each range sorts its suffixes, and the reversed bytes before them, word by word
   among ties only (multikey quicksort). Runs of common prefixes in both orders give the
   windows that are equal, and the least document of each. As splitters are keys of
   anchors, every boundary falls between different anchors and no window has to be
   compared across it.
5. Cells turn the answers into removed byte ranges.

A passage that very many documents share is folded to one entry per cell before it is
sent. The text is shuffled once: all steps stand in one query and reuse that exchange.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import U64, mix, text_bytes
from trialspark.llm.stored import partitions_for

WINDOW = 50
ANCHOR = 20
PLACES = WINDOW - ANCHOR + 1
CELL_BYTES = 8 << 20
MAX_SPLITTERS = 4096
SAMPLE_BYTES = 2 << 20
# Contexts, added up over cells, from which an anchor's windows are dealt one by one.
HOT_CONTEXTS = 2048

_BEFORE, _AFTER = 32, 56
_CHUNK = 1 << 16
_LOW = U64((1 << 21) - 1)
_NEVER = np.iinfo(np.int64).max

_MESSAGE = "cell long, kind int, bucket long, n long, data binary"


def _word_at_each_byte(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` positions on, as one integer."""
    padded = np.zeros(n + 16, np.uint8)
    padded[: min(len(data), n + 16)] = data[: n + 16]
    out = np.empty(n, U64)
    for shift in range(min(8, n)):
        part = padded[shift:]
        whole = part[: len(part) // 8 * 8].view(U64)
        out[shift::8] = whole[: len(out[shift::8])]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window of each run of windows with one anchor, and anchor hash.

    Windows never cross texts. A window's anchor depends on its bytes alone.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(len(data) - WINDOW + 1, 0), _CHUNK):
        part = data[base : base + _CHUNK + WINDOW - 1]
        n_windows, n_anchors = len(part) - WINDOW + 1, len(part) - ANCHOR + 1
        ends = offsets[(offsets > base) & (offsets < base + len(part))] - base
        edge = np.zeros(n_windows + 1, np.int32)
        np.add.at(edge, np.minimum(np.maximum(ends - WINDOW + 1, 0), n_windows), 1)
        np.add.at(edge, np.minimum(ends, n_windows), -1)
        window = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        if not len(window):
            continue
        word = _word_at_each_byte(part, len(part))
        value = word[:n_anchors] * U64(0x9E3779B97F4A7C15)
        value ^= value >> U64(29)
        value += word[8 : 8 + n_anchors] * U64(0xD6E8FEB86659FD93)
        value *= U64(0xBF58476D1CE4E5B9)
        value ^= value >> U64(32)
        value += word[16 : 16 + n_anchors] << U64(32)
        value *= U64(0x94D049BB133111EB)
        value ^= value >> U64(29)
        value *= U64(0xC2B2AE3D27D4EB4F)
        key = (value & ~_LOW) | np.arange(n_anchors, dtype=U64)
        width = 1
        while width * 2 <= PLACES:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < PLACES:
            key = np.minimum(key[: n_windows], key[PLACES - width : PLACES - width + n_windows])
        anchor = (key[window] & _LOW).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(window)])) - 1
        found.append((anchor[first] + base, window[first] + base, window[last] + base, value[anchor[first]]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U64)
    anchor, first, last, value = (np.concatenate(columns) for columns in zip(*found))
    # A run cut by the border of a chunk is one run: results must not depend on the order of texts.
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
    opens = np.flatnonzero(new)
    return anchor[opens], first[opens], last[np.concatenate((opens[1:], [len(anchor)])) - 1], value[opens]


def sorted_order(columns: list[np.ndarray]) -> np.ndarray:
    """Lexicographic order by columns; each next column is looked at among ties only."""
    order = np.argsort(columns[0], kind="stable")
    if len(order) < 2:
        return order
    group = np.concatenate(([0], np.cumsum(np.diff(columns[0][order]) != 0)))
    for column in columns[1:]:
        new = np.concatenate(([True], group[1:] != group[:-1]))
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(tied):
            break
        members = order[tied]
        inner = np.lexsort((column[members], group[tied]))
        order[tied] = members[inner]
        same = column[order[1:]] == column[order[:-1]]
        group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | ~same)))
    return order


def common_prefix(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in ``order`` (big-endian columns)."""
    lengths = np.zeros(len(order), np.int64)
    going = np.ones(len(order), bool)
    going[:1] = False
    for column in columns:
        differ = column[order] ^ np.concatenate((column[order[:1]], column[order[:-1]]))
        zero_bytes = np.full(len(order), 8)
        bits = differ.copy()
        for shift in (32, 16, 8):
            high = bits >> U64(shift)
            bits = np.where(high > 0, high, bits)
            zero_bytes = np.where(high > 0, zero_bytes - shift // 8, zero_bytes)
        zero_bytes = np.where(differ > 0, zero_bytes - 1, 8)
        lengths += np.where(going, zero_bytes, 0)
        going &= differ == 0
    return lengths


class _Cell:
    """The texts of one cell, their anchors and, once known, the shared entries."""

    def __init__(self, table: pa.Table) -> None:
        column = pa.concat_arrays(table.column("text").cast(pa.large_string()).chunks or [pa.array([], pa.large_string())])
        self.data, self.offsets = text_bytes(column)
        ids = table.column("doc_id")
        self.has_id = np.asarray(ids.is_valid(), dtype=bool)
        self.ids = np.asarray(ids.fill_null(0), dtype=np.int64)
        anchor, first, last, value = anchors(self.data, self.offsets)
        text = np.searchsorted(self.offsets, first, "right") - 1
        known = self.has_id[text]
        self.anchor, self.first, self.last = anchor[known], first[known], last[known]
        # An anchor's hash is the least of many, so it is spread anew before it is dealt by range.
        self.value, self.text = mix(value[known]), text[known]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, which of them two documents of this cell have, and their contexts."""
        padded = np.concatenate((np.zeros(8, np.uint8), self.data, np.zeros(ANCHOR + 8, np.uint8)))
        word = _word_at_each_byte(padded, len(padded))
        context = mix(word[self.anchor] ^ mix(word[self.anchor + 8 + ANCHOR]))
        order = np.lexsort((context, self.value))
        value, ids, context = self.value[order], self.ids[self.text[order]], context[order]
        if not len(value):
            return value, np.zeros(0, bool), np.zeros(0, np.uint32)
        new = np.concatenate(([True], value[1:] != value[:-1]))
        starts = np.flatnonzero(new)
        other = new | np.concatenate(([True], context[1:] != context[:-1]))
        contexts = np.add.reduceat(other.astype(np.int64), starts).astype(np.uint32)
        return value[starts], np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts), contexts

    def keep_shared(self, answers: dict[int, tuple[int, bytes]], n_buckets: int) -> None:
        value, _, _ = self.distinct()
        shared, hot = np.zeros((2, len(value)), bool)
        bounds = np.searchsorted(_bucket_of(value, n_buckets), np.arange(n_buckets + 1))
        for bucket, (_, data) in answers.items():
            low, high = bounds[bucket : bucket + 2]
            bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(2, -1)[:, : high - low]
            shared[low:high], hot[low:high] = bits.astype(bool)
        at = np.searchsorted(value, self.value)
        held = shared[at] if len(value) else np.zeros(0, bool)
        self.hot = hot[at][held] if len(value) else held
        names = ("anchor", "first", "last", "value", "text")
        for name in names:
            setattr(self, name, getattr(self, name)[held])
        if self.hot.any():
            # One row for each window of a hot anchor.
            windows = np.where(self.hot, self.last - self.first + 1, 1)
            row = np.repeat(np.arange(len(windows)), windows)
            step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            for name in (*names, "hot"):
                setattr(self, name, getattr(self, name)[row])
            self.first = self.first + np.where(self.hot, step, 0)
            self.last = np.where(self.hot, self.first, self.last)

    def entries(self) -> None:
        """Distinct suffixes with the bytes before them; ``entry`` maps each anchor to its own."""
        n = len(self.anchor)
        padded = np.concatenate((np.zeros(_BEFORE, np.uint8), self.data, np.zeros(_AFTER, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, _BEFORE + _AFTER)[self.anchor]
        after = rows[:, _BEFORE:] * (np.arange(_AFTER) < (self.last + WINDOW - self.anchor)[:, None])
        before = rows[:, :_BEFORE][:, ::-1] * (np.arange(_BEFORE) < (self.anchor - self.first)[:, None])
        self.nearest, self.farthest = self.anchor - self.last, self.anchor - self.first
        keys = np.concatenate((_columns(after), _columns(before)))
        places = (self.nearest << 8 | self.farthest).astype(U64)
        keys = np.concatenate((keys, (places | self.hot.astype(U64) << U64(16))[None, :]))
        order = sorted_order(list(keys))
        moved = keys[:, order]
        new = np.ones(n, bool)
        new[1:] = (moved[:, 1:] != moved[:, :-1]).any(0)
        self.entry = np.empty(n, np.int64)
        self.entry[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.keys = moved[:, starts]
        ids = self.ids[self.text[order]]
        self.least = np.minimum.reduceat(ids, starts) if n else np.zeros(0, np.int64)


def _columns(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of integers in the same lexicographic order."""
    return np.ascontiguousarray(rows).view(">u8").astype(U64).T.reshape(rows.shape[1] // 8, len(rows))


def _bucket_of(value: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((value >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)


class Ranges(NamedTuple):
    """Splitters of leading words, the parts that a hash of the anchor cuts each range into, and the parts of hot windows."""

    splitters: np.ndarray
    cuts: np.ndarray
    hot: int


def _range_of(keys: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Range by the leading eight bytes and a hash of the anchor's 20 bytes; hot windows by all their bytes."""
    anchor = mix(keys[0] ^ mix(keys[1] ^ mix(keys[2] >> U64(32))))
    at = np.searchsorted(ranges.splitters, keys[0], "right")
    begins = np.concatenate(([0], np.cumsum(ranges.cuts)))
    own = begins[at] + (anchor % ranges.cuts[at].astype(U64)).astype(np.int64)
    window = keys[-1]
    for column in keys[:-1]:
        window = mix(window ^ column)
    is_hot = keys[-1] >> U64(16) > 0
    return np.where(is_hot, begins[-1] + (window % U64(ranges.hot)).astype(np.int64), own)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ["cell", "kind", "bucket", "n", "data"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_ASK, _ANSWER, _ENTRIES, _LEAST = range(4)


def _ask(n_buckets: int):
    """Step 2, in cells: distinct anchor hashes, dealt to hash ranges."""

    def ask(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        value, several, contexts = _Cell(table).distinct()
        bucket = _bucket_of(value, n_buckets)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(value) else []
        rows = []
        for low, high in zip(starts, [*starts[1:], len(value)]):
            data = value[low:high].tobytes() + contexts[low:high].tobytes() + np.packbits(several[low:high]).tobytes()
            rows.append((cell, _ASK, int(bucket[low]), int(high - low), data))
        return _messages(rows)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, in hash ranges: two bits for each hash asked for."""
    cells, sizes = table.column("cell").to_pylist(), table.column("n").to_pylist()
    blobs, bucket = table.column("data").to_pylist(), table.column("bucket")[0].as_py()
    value = np.concatenate([np.frombuffer(b, U64, n) for b, n in zip(blobs, sizes)])
    contexts = np.concatenate([np.frombuffer(b, np.uint32, n, offset=8 * n) for b, n in zip(blobs, sizes)])
    several = [np.unpackbits(np.frombuffer(b, np.uint8, offset=12 * n), count=n) for b, n in zip(blobs, sizes)]
    order = np.argsort(value)
    starts = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1])))
    counts = np.diff(np.concatenate((starts, [len(value)])))
    shared = (counts > 1) | (np.maximum.reduceat(np.concatenate(several)[order], starts) > 0)
    hot = np.add.reduceat(contexts[order].astype(np.int64), starts) > HOT_CONTEXTS
    flags, hots = np.empty((2, len(value)), bool)
    flags[order], hots[order] = np.repeat(shared, counts), np.repeat(hot, counts)
    rows, low = [], 0
    for cell, n in zip(cells, sizes):
        part, hot_part = flags[low : low + n], hots[low : low + n]
        low += n
        if part.any():
            rows.append((cell, _ANSWER, bucket, n, np.packbits(part).tobytes() + np.packbits(hot_part).tobytes()))
    return _messages(rows)


def _read(table: pa.Table, kind: int) -> dict[int, tuple[int, bytes]]:
    """Number of items and content of each message of a kind, by the bucket that sent it."""
    rows = zip(*(table.column(name).to_pylist() for name in ("kind", "bucket", "n", "data")))
    return {bucket: (n, data) for found, bucket, n, data in rows if found == kind}


def _shared_cell(docs: pa.Table, said: pa.Table, n_buckets: int) -> _Cell:
    cell = _Cell(docs)
    cell.keep_shared(_read(said, _ANSWER), n_buckets)
    cell.entries()
    return cell


def _by_range(cell: _Cell, ranges: Ranges):
    bucket = _range_of(cell.keys, ranges)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, bounds) if len(part)]


def _send(n_buckets: int, ranges: Ranges):
    """Step 3: distinct entries of shared anchors, dealt to ranges of their leading bytes."""

    def send(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows or not said.num_rows:
            return _messages([])
        number = docs.column("cell")[0].as_py()
        cell = _shared_cell(docs, said, n_buckets)
        rows = []
        for bucket, part in _by_range(cell, ranges):
            bytes_ = np.ascontiguousarray(cell.keys[:, part].T).astype(">u8").tobytes()
            data = pa.compress(bytes_ + cell.least[part].tobytes(), "zstd", asbytes=True)
            rows.append((number, _ENTRIES, bucket, len(part), data))
        return _messages(rows)

    return send


_WIDTH = (_BEFORE + _AFTER) // 8 + 1


def _least_documents(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each entry and place of a window in it, the least document with that window.

    ``keys``: columns of one whole group of anchors. Places an entry doesn't have are never.
    """
    after, before = list(keys[: _AFTER // 8]), list(keys[_AFTER // 8 : -1])
    nearest, farthest = ((keys[-1] >> U64(s) & U64(255)).astype(np.int64) for s in (8, 0))
    classes = []
    for columns in (after, before):
        order = sorted_order(columns)
        classes.append((order, common_prefix(columns, order)))
    out = np.full((len(least), PLACES), _NEVER)
    for place in range(PLACES):
        held = np.flatnonzero((nearest <= place) & (place <= farthest))
        if not len(held):
            continue
        ranks = []
        for (order, shared), length in zip(classes, (WINDOW - place, place)):
            rank = np.empty(len(least), np.int64)
            rank[order] = np.cumsum(shared < length) if length else 0
            ranks.append(rank[held])
        key = ranks[0] << 32 | ranks[1]
        order = np.argsort(key)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        lows = np.minimum.reduceat(least[held][order], starts)
        out[held[order], place] = np.repeat(lows, np.diff(np.concatenate((starts, [len(held)]))))
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Step 4: runs of places whose window a lesser document has, for each cell's entries."""
    bucket, cells = table.column("bucket")[0].as_py(), table.column("cell").to_pylist()
    sizes, blobs = table.column("n").to_pylist(), table.column("data")
    keys, least, owner, index = [], [], [], []
    for i, n in enumerate(sizes):
        raw = pa.decompress(blobs[i].as_py(), n * 8 * (_WIDTH + 1), "zstd", asbytes=True)
        keys.append(np.frombuffer(raw, ">u8", n * _WIDTH).reshape(n, _WIDTH).T.astype(U64))
        least.append(np.frombuffer(raw, np.int64, n, offset=n * _WIDTH * 8))
        owner.append(np.full(n, i))
        index.append(np.arange(n))
    keys, least = np.concatenate(keys, 1), np.concatenate(least)
    owner, index = np.concatenate(owner), np.concatenate(index)
    anchor = [keys[0], keys[1], keys[2] >> U64(32)]
    order = sorted_order(anchor)
    new = np.zeros(len(order), bool)
    for column in anchor:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    starts = np.concatenate(([0], np.flatnonzero(new), [len(order)]))
    found: list[list[np.ndarray]] = [[] for _ in sizes]
    low = 0
    while low < len(order):
        high = int(starts[max(np.searchsorted(starts, low + 50_000, "right") - 1, np.searchsorted(starts, low, "right"))])
        part = order[low:high]
        low = high
        places = _least_documents(keys[:, part], least[part])
        lesser = places < least[part][:, None]
        changed = np.ones(places.shape, bool)
        changed[:, 1:] = places[:, 1:] != places[:, :-1]
        row, start = np.nonzero(changed & lesser)
        if not len(row):
            continue
        border = np.concatenate((changed[:, 1:], np.ones((len(part), 1), bool)), 1)
        _, stop = np.nonzero(border & lesser)
        runs = np.stack((index[part][row], start, stop, places[row, start]))
        own = owner[part][row]
        by_owner = np.argsort(own, kind="stable")
        for piece in np.split(by_owner, np.flatnonzero(np.diff(own[by_owner])) + 1):
            found[own[piece[0]]].append(runs[:, piece])
    rows = []
    for i, parts in enumerate(found):
        if parts:
            runs = np.ascontiguousarray(np.concatenate(parts, 1))
            rows.append((cells[i], _LEAST, bucket, runs.shape[1], pa.compress(runs.tobytes(), "zstd", asbytes=True)))
    return _messages(rows)


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def _remove(n_buckets: int, ranges: Ranges, with_kept: bool):
    """Step 5: removed ranges of each text of a cell."""

    def remove(docs: pa.Table, said: pa.Table) -> pa.Table:
        cell = _shared_cell(docs, said, n_buckets)
        starts, ends = [], []
        own = cell.ids[cell.text]
        earlier = cell.least[cell.entry] < own if len(own) else np.zeros(0, bool)
        starts.append(cell.first[earlier])
        ends.append(cell.last[earlier] + WINDOW)
        order = np.argsort(cell.entry, kind="stable")
        entry = cell.entry[order]
        answers = _read(said, _LEAST)
        for bucket, part in _by_range(cell, ranges) if answers else ():
            if bucket not in answers:
                continue
            n, data = answers[bucket]
            runs = np.frombuffer(pa.decompress(data, 32 * n, "zstd", asbytes=True), np.int64)
            runs = runs.reshape(4, n)
            low = np.searchsorted(entry, part[runs[0]])
            count = np.searchsorted(entry, part[runs[0]], "right") - low
            which = np.repeat(np.arange(n), count)
            member = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]]
            later = own[member] > runs[3][which]
            member, which = member[later], which[later]
            starts.append(cell.anchor[member] - runs[2][which])
            ends.append(cell.anchor[member] - runs[1][which] + WINDOW)
        size = len(cell.data)
        depth = np.bincount(np.concatenate(starts), minlength=size + 1)
        depth -= np.bincount(np.concatenate(ends), minlength=size + 1)
        removed = np.cumsum(depth[:-1]) > 0
        return _kept(cell, removed, with_kept)

    return remove


def _kept(cell: _Cell, removed: np.ndarray, with_kept: bool) -> pa.Table:
    n, offsets = len(cell.ids), cell.offsets
    begins = offsets[:-1][offsets[:-1] < len(removed)]
    first = removed.copy()
    first[1:] &= ~removed[:-1]
    first[begins] = removed[begins]
    last = removed.copy()
    last[:-1] &= ~removed[1:]
    closes = begins[begins > 0] - 1
    last[closes] = removed[closes]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    kept = [cell.data[low:high][~removed[low:high]].tobytes() for low, high in zip(offsets, offsets[1:])]
    spans = pa.StructArray.from_arrays(
        [pa.array(start - offsets[text], pa.int64()), pa.array(end - offsets[text], pa.int64())],
        ["start", "end"],
    )
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).astype(np.int32)
    return pa.table(
        {
            "doc_id": pa.array(cell.ids, mask=~cell.has_id),
            "n_bytes": pa.array(np.diff(offsets)),
            "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
            "kept": pa.array(kept if with_kept else [None] * n, pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
    )


def _ranges(docs: DataFrame, n_bytes: int, n_cells: int) -> Ranges:
    """Ranges from the leading words of anchors of sampled documents, at even steps of their order."""
    wanted = min(n_cells, MAX_SPLITTERS)

    def leading(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            anchor = anchors(data, offsets)[0]
            word = _word_at_each_byte(data, len(data))[anchor] if len(anchor) else np.zeros(0, U64)
            lead = np.sort(word.byteswap())[:: max(1, len(word) // 20_000)]
            yield pa.record_batch([pa.array(lead.view(np.int64))], ["lead"])

    share = min(1.0, SAMPLE_BYTES / max(n_bytes, 1))
    sampled = docs.select("text").sample(share, seed=7).mapInArrow(leading, "lead long")
    lead = np.sort(np.array([row[0] for row in sampled.collect()], np.int64).view(U64))
    steps = lead[:: max(1, len(lead) // wanted)][1:]
    splitters, times = np.unique(steps, return_counts=True)
    # The range that begins with a splitter holds all anchors with that word: cut it as often as it came.
    cuts = np.concatenate(([1], times)) * -(-n_cells // max(1, len(steps)))
    return Ranges(splitters, cuts.astype(np.int64), n_cells)


def repeated_bytes(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Byte ranges of each text of ``docs(doc_id, text)`` that a lesser document already has.

    Returns ``doc_id, n_bytes, spans, kept, kept_sha256``: ``spans`` are the maximal runs
    of bytes covered by a 50-byte string that also starts in a document with a smaller
    id; ``kept`` holds the other bytes if ``with_kept``. Null text is empty. Texts below
    50 bytes lose nothing. Rows that repeat an id don't remove each other's bytes, as
    neither id is smaller. A row with a null id neither loses bytes nor takes any.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells = partitions_for(spark, n_bytes, CELL_BYTES)
    ranges = _ranges(docs, n_bytes, n_cells)
    id_or_text = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(
        F.col("doc_id").isNull(), F.xxhash64("text") % 1_000_003
    ).otherwise(0)
    celled = docs.withColumn("cell", F.pmod(id_or_text, F.lit(n_cells))).repartition("cell")
    asked = celled.groupBy("cell").applyInArrow(_ask(n_cells), _MESSAGE)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _MESSAGE).repartition("cell")
    sent = (
        celled.groupBy("cell")
        .cogroup(answers.groupBy("cell"))
        .applyInArrow(_send(n_cells, ranges), _MESSAGE)
    )
    compared = sent.groupBy("bucket").applyInArrow(_compare, _MESSAGE).repartition("cell")
    return (
        celled.groupBy("cell")
        .cogroup(answers.union(compared).groupBy("cell"))
        .applyInArrow(_remove(n_cells, ranges, with_kept), _RESULT)
    )
