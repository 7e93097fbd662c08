"""Benchmark decontamination by a broadcast set of test n-grams, in DataFrame functions only.

Every benchmark item gives its windows of 13 words (a shorter item its whole sequence).
A bitmap of hashes of four words of each window goes to every task; documents test all
their positions against it in one pass and only the windows that pass are compared, on
their full words, with the broadcast windows. Both are small by proof: the windows are
counted first and cut into shards of at most ``SHARD_WINDOWS`` windows and
``SHARD_BYTES`` bytes; each further shard costs one more pass over the documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.stored import stored

WINDOW = 13
SHARD_WINDOWS = 1 << 17
SHARD_BYTES = 16 << 20
BITS_PER_WINDOW = 64
# Contaminated: at least one word in twenty is hit.
HIT_FACTOR = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEADING_GAP = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: str) -> Column:
    """Normalised words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def _probe(words: Column, start: Column, length: Column | int) -> Column:
    """Hash of four words spread over a window."""
    length = F.lit(length) if isinstance(length, int) else length
    steps = [F.floor((length - 1) * k / 3).cast("int") for k in range(4)]
    return F.xxhash64(length.cast("int"), *(F.get(words, start + step) for step in steps))


def _joined(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``shard_key, probe, length, window, items``: distinct windows with the items that have them."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    windows = items.select("item_id", "words", length.alias("length"), F.explode(starts).alias("start"))
    keyed = windows.select(
        "item_id",
        "length",
        _probe(F.col("words"), F.col("start"), F.col("length")).alias("probe"),
        _joined(F.col("words"), F.col("start"), F.col("length")).alias("window"),
    )
    return keyed.groupBy("length", "probe", "window").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )


def _bitmap(probes: np.ndarray) -> tuple[Column, int]:
    """Set of hashes as a constant array of longs, and its number of bits (a power of two)."""
    n_bits = 1 << max(10, int(len(probes) * BITS_PER_WINDOW - 1).bit_length())
    place = probes.view(np.uint64) & np.uint64(n_bits - 1)
    held = np.zeros(n_bits // 64, np.uint64)
    np.bitwise_or.at(held, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    text = ",".join(map(str, held.view(np.int64).tolist()))
    return F.split(F.lit(text), ",").cast("array<bigint>"), n_bits


def _candidates(words: Column, lengths: list[int], bitmap: Column, n_bits: int) -> Column:
    """Windows whose hash is in the bitmap, as ``(start, length, window)``."""
    kind = "array<struct<start:int,length:int,window:string>>"

    def of_length(length: int) -> Column:
        def held(start: Column) -> Column:
            place = _probe(words, start, length).bitwiseAND(F.lit(n_bits - 1))
            return F.getbit(F.get(bitmap, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63))) == 1

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - length), held)
        found = F.transform(
            starts,
            lambda start: F.struct(
                start.alias("start"),
                F.lit(length).alias("length"),
                _joined(words, start, length).alias("window"),
            ),
        )
        return F.when(F.size(words) >= length, found).otherwise(F.array().cast(kind))

    return F.concat(*(of_length(length) for length in lengths)) if lengths else F.array().cast(kind)


def _shards(benchmark: DataFrame) -> list[tuple[DataFrame, list[int], Column, int]]:
    windows = stored(benchmark_windows(benchmark), "windows")
    n, size = windows.agg(
        F.coalesce(F.sum(F.size("items")), F.lit(0)),
        F.coalesce(F.sum(F.octet_length("window") + 16 * F.size("items")), F.lit(0)),
    ).first()
    n_shards = max(1, -(-n // SHARD_WINDOWS), -(-size // SHARD_BYTES))
    out = []
    for shard in range(n_shards):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_shards)) == shard)
        rows = part.select("probe", "length").collect()
        probes = np.array([row["probe"] for row in rows], np.int64)
        out.append((part, sorted({row["length"] for row in rows}), *_bitmap(probes)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words hit by benchmark windows, for every row of ``docs(doc_id, text)``.

    Returns ``doc_id, text_key, n_words, hits, n_hit, items, contaminated``: ``hits`` are the
    positions of hit words, ``items`` the ids of the items with an occurring window, as
    sorted strings, ``text_key`` a hash of the text. Null and wordless texts have no hits.
    Repeated rows are judged one by one; null ids go through; an empty benchmark hits
    nothing; other columns are ignored.
    """
    base = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
        words_of("text").alias("words"),
    )
    found = []
    for windows, lengths, bitmap, n_bits in _shards(benchmark):
        held = _candidates(F.col("words"), lengths, bitmap, n_bits)
        tested = base.select("doc_id", "text_key", "row", F.size("words").alias("n_words"), held.alias("held"))
        rows = tested.select("doc_id", "text_key", "row", "n_words", F.explode_outer("held").alias("hit"))
        small = F.broadcast(windows.select(F.col("window").alias("same"), "items"))
        found.append(
            rows.join(small, F.col("hit.window") == F.col("same"), "left").select(
                "doc_id",
                "text_key",
                "row",
                "n_words",
                F.when(F.col("same").isNotNull(), F.struct("hit.start", "hit.length")).alias("span"),
                "items",
            )
        )
    rows = reduce(DataFrame.union, found)
    grouped = rows.groupBy("row", "doc_id", "text_key", "n_words").agg(
        F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")
    )
    covered = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    hits = F.array_sort(F.array_distinct(F.flatten(covered)))
    n_hit = F.size("hits").cast("long")
    return grouped.select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        hits.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    ).select(
        "doc_id",
        "text_key",
        "n_words",
        "hits",
        n_hit.alias("n_hit"),
        "items",
        ((n_hit > 0) & (HIT_FACTOR * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), "text_key"
    )
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"])
    return docs.join(bad.distinct(), same, "left_anti")


def without_hit_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit word, and the gap behind it, cut out of its text.

    Other columns go through by position, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    judged = contamination(docs, benchmark).where("n_hit > 0")
    hit = judged.select(F.col("doc_id").alias("hit_id"), "text_key", "hits").distinct()
    joined = plain.join(hit, key.eqNullSafe(F.col("hit_id")) & (F.xxhash64(text) == F.col("text_key")), "left")
    parts = F.regexp_extract_all(text, F.lit(_WORD_AND_GAP), F.lit(0))
    kept = F.filter(parts, lambda part, i: ~F.array_contains("hits", i))
    cut = F.concat(F.regexp_extract(text, _LEADING_GAP, 0), F.array_join(kept, ""))
    clean = F.when(F.col("hits").isNull(), text).otherwise(cut)
    columns = [clean.alias(n) if c == "text" else F.col(n) for n, c in zip(names, docs.columns)]
    return joined.select(*columns).toDF(*docs.columns)
