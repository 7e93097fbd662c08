"""Fill-in-middle training texts, cut at line boundaries.

The boundaries of a text's units (lines with their line end) go into a compressed set of
code point offsets, laid out as in Roaring bitmaps: values are split by their high 16 bits
into containers, each kept as a sorted array, a bitmap or runs, whichever is smallest, with
the cumulative cardinality before each container. The k-th boundary is found by a search
over the cardinalities and a select inside one container. Python returns the two cut
offsets only; texts are put together, and taken apart again, by DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import slices, text_bytes

HIGH_BITS = 16
BITMAP_BYTES = (1 << HIGH_BITS) // 8


@dataclass(frozen=True)
class Settings:
    """Seed of the draws, shares of cut texts and of the suffix-first form, and the marks."""

    seed: str = "7"
    cut_percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for a in self.marks:
            for b in self.marks:
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"the end of {a!r} is a beginning of {b!r}: texts could not be taken apart")
                if not a or (a != b and a in b):
                    raise ValueError("a mark must be neither empty nor part of another one")
        if len(set(self.marks)) < 3:
            raise ValueError("the three marks must differ")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class ArrayContainer:
    """Sorted low halves."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)
        self.size = 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per low half, with the number of bits before each word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << HIGH_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))))
        self.size = BITMAP_BYTES

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        held = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            held &= held - 1
        return 64 * word + (held & -held).bit_length() - 1


class RunContainer:
    """Starts of runs of consecutive low halves, with the number of values before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = starts
        self.before = np.concatenate(([0], np.cumsum(lengths)))
        self.size = 4 * len(starts)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of some sorted, distinct low halves."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    if 4 * (len(breaks) + 1) < min(2 * len(low), BITMAP_BYTES):
        first = np.concatenate(([0], breaks))
        return RunContainer(low[first], np.diff(np.concatenate((first, [len(low)]))))
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(low)


@dataclass
class BoundarySet:
    """Sorted, distinct offsets with the k-th of them (from 0) at hand."""

    values: np.ndarray
    highs: np.ndarray = field(init=False)
    before: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        high = self.values >> HIGH_BITS
        first = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        ends = np.concatenate((first[1:], [len(high)]))
        low = self.values & ((1 << HIGH_BITS) - 1)
        self.highs = high[first]
        self.before = np.concatenate((first, [len(high)]))
        self.containers = [container(low[a:b]) for a, b in zip(first, ends)]
        del self.values

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.highs[at]) << HIGH_BITS) + self.containers[at].select(k - int(self.before[at]))


def boundaries(starts_before: np.ndarray, newlines: np.ndarray, n_chars: int) -> BoundarySet:
    """0 and the ends of all units; ``newlines``: byte positions of line ends in one text.

    ``starts_before`` has, for each byte of it, the code points that begin up to there.
    """
    ends = starts_before[newlines]
    if n_chars and (not len(ends) or ends[-1] != n_chars):
        ends = np.append(ends, n_chars)
    return BoundarySet(np.concatenate(([0], ends)))


def _cuts_of(part: pa.RecordBatch) -> np.ndarray:
    """Units, and both cut offsets in code points, of each text of a batch."""
    data, offsets = text_bytes(part.column("text"))
    begun = np.cumsum((data & 0xC0) != 0x80)
    newlines = np.flatnonzero(data == 10)
    held = np.searchsorted(newlines, offsets)
    draws = np.stack([np.asarray(part.column(name)) for name in ("first", "second")])
    out = np.zeros((part.num_rows, 3), np.int64)
    for i, (low, high) in enumerate(zip(offsets, offsets[1:])):
        base = int(begun[low - 1]) if low else 0
        n_chars = int(begun[high - 1]) - base if high > low else 0
        ends = boundaries(begun[low:high] - base, newlines[held[i] : held[i + 1]] - low, n_chars)
        ranks = np.sort(draws[:, i] % len(ends))
        out[i] = len(ends) - 1, ends.select(int(ranks[0])), ends.select(int(ranks[1]))
    return out


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text, first, second], ["text", "first", "second"])
    found = [_cuts_of(part) for part in slices(batch, "text")]
    columns = np.concatenate(found or [np.zeros((0, 3), np.int64)]).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "begin", "end"])


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:doc_id``; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def cut(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text, ..)`` with ``n, form, prefix_chars, middle_chars, output``.

    ``n`` units are the lines of a text with their line ends. ``form`` is ``plain`` for an
    empty or null text, one that contains a mark, or one outside the share of cut texts:
    its output is the text (null: empty) and its lengths are null. Otherwise it is ``psm``
    or ``spm``; prefix, middle and suffix may each be empty. Rows with one ``doc_id`` get
    the same draws. Other columns stay; those named like a new one are replaced.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = docs.drop(*new)
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)
    text = F.coalesce(F.col(names[kept.columns.index("text")]), F.lit(""))
    h = draws(F.col(names[kept.columns.index("doc_id")]), settings.seed)
    found = F.arrow_udf(_cuts, "n long, begin long, end long")(text, h[0], h[1])
    rows = plain.withColumn("cuts", found)

    marked = F.lit(False)
    for mark in settings.marks:
        marked = marked | F.contains(text, F.lit(mark))
    whole = (text == "") | marked | (h[2] % 100 >= settings.cut_percent)
    form = F.when(whole, "plain").when(h[3] % 100 < settings.spm_percent, "spm").otherwise("psm")
    begin, end = F.col("cuts.begin").cast("int"), F.col("cuts.end").cast("int")
    prefix, middle = F.substring(text, F.lit(1), begin), F.substring(text, begin + 1, end - begin)
    # A length beyond the end of a text stops there.
    suffix = F.substring(text, end + 1, F.lit((1 << 31) - 1) - end)
    p, s, m = map(F.lit, settings.marks)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut_only = F.col("form") != "plain"
    done = rows.withColumn("form", form).select(
        *names,
        F.col("cuts.n").alias("n"),
        "form",
        F.when(cut_only, F.col("cuts.begin")).alias("prefix_chars"),
        F.when(cut_only, F.col("cuts.end") - F.col("cuts.begin")).alias("middle_chars"),
        output.alias("output"),
    )
    return done.toDF(*kept.columns, *new)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The exact text from an output and its form: marks occur in a cut text nowhere else."""
    p, s, m = settings.marks
    middle = F.substring_index(output, m, -1)
    front = F.substring_index(output, m, 1)

    def after(mark: str, text: Column) -> Column:
        return F.substring(text, F.lit(len(mark) + 1), F.length(text))

    psm = F.concat(after(p, F.substring_index(front, s, 1)), middle, F.substring_index(front, s, -1))
    spm = F.concat(F.substring_index(front, p, -1), middle, after(s, F.substring_index(front, p, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
