"""Near-duplicate documents by b-bit MinHash.

1. Each document's set of word shingles gives minima, 96 for a threshold of 0.85 and 128
   for 0.80. Runs of four make 24 or 32 band keys; the low four bits of every minimum are
   packed into a sketch of 48 or 64 bytes.
2. Documents with one and the same set form a class with its least id as
   representative (aggregated map-side, so a class may hold any share of all rows).
3. Representatives that share a band key are candidates. Inside a bucket of up to 512 the
   sketches are compared by bit counts, corrected for chance agreement, and a spanning
   forest of the pairs that may be similar leaves the task. A larger bucket is taken as one
   cluster of candidates as it is: a chain of its members, however many.
4. Candidate clusters (components of 3) are confirmed on the full sets, block by block. A
   cluster of more than one chunk first meets its chunk 0 alone, so each text is sent about
   twice however large the cluster is, and most members hang together after that. Only
   members outside the largest part found so far then meet all others.
5. Components of the confirmed links.

A pair that has met neither inside its chunk nor through chunk 0 is missed by no step: two
texts in one part are in one component already, and of two texts in different parts at
least one is outside the largest part and meets the other in the second pass.

The number of bands and the sketch's bar follow from the threshold: two documents at it
share no band with a chance of at most 5e-8, and fall below the bar with one of at most
5e-9; everything else is exact, up to 64-bit hash collisions of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.arrays import LOWER, U64, least_labels, mix, runs, shingles, slices, text_bytes
from trialspark.llm.components import connected_components
from trialspark.llm.stored import stored

SHINGLE_WORDS = 5
MIN_PERCENT = 85
ROWS, BITS = 4, 4
NO_BAND, BELOW_BAR = 5e-8, 5e-9
BUCKET_CHUNK = 512
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 256, 1_000_000

# Bytes of text whose shingles are held at once.
PART_BYTES = 1 << 18

_NIBBLE_ONES = U64(0x1111111111111111)

SIGNATURE = (
    "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"
)


def bands_for(min_percent: int) -> int:
    """Bands, in whole 64-bit words of sketch, of which a pair at the threshold shares one."""
    if not 50 <= min_percent <= 100:
        raise ValueError("min_percent must be between 50 and 100")
    bands = 4
    while (1 - (min_percent / 100) ** ROWS) ** bands > NO_BAND:
        bands += 4
    return bands


def sketch_bar(min_percent: int) -> float:
    """Estimated similarity that a pair at the threshold reaches."""
    hashes, chance = bands_for(min_percent) * ROWS, 2.0**-BITS
    agree = min_percent / 100 * (1 - chance) + chance
    # Matches at which the chance to have fewer is still small.
    matches, fewer = 0, 0.0
    while matches < hashes:
        fewer += comb(hashes, matches) * agree**matches * (1 - agree) ** (hashes - matches)
        if fewer > BELOW_BAR:
            break
        matches += 1
    return ((matches - 0.5) / hashes - chance) / (1 - chance)


@lru_cache
def _hashing(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of the hash functions."""
    random = np.random.default_rng(20240917)
    factors = random.integers(0, 1 << 63, hashes, dtype=np.uint64) * U64(2) + U64(1)
    return factors, random.integers(0, 1 << 63, hashes, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the ``text`` column, text by text, and where each text begins."""
    data, offsets = text_bytes(batch.column("text"))
    value, of = shingles(LOWER[data], offsets, SHINGLE_WORDS)
    bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
    sets = [np.unique(value[low:high]) for low, high in zip(bounds, bounds[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def _sign(batch: pa.RecordBatch, bands: int) -> pa.RecordBatch:
    hashes = bands * ROWS
    factors, terms = _hashing(hashes)
    value, bounds = shingle_sets(batch)
    n, sizes = batch.num_rows, np.diff(bounds)
    full = np.flatnonzero(sizes)
    starts = bounds[:-1][full]
    minima = np.empty((len(full), hashes), U64)
    set_a, set_b = np.zeros(n, U64), np.zeros(n, U64)
    if len(full):
        for i in range(hashes):
            minima[:, i] = np.minimum.reduceat(value * factors[i] + terms[i], starts)
        set_a[full] = np.add.reduceat(mix(value), starts)
        set_b[full] = np.add.reduceat(mix(value ^ terms[0]), starts)
    mixed = mix(minima)
    keys = np.zeros((len(full), bands), U64)
    for row in range(ROWS):
        keys = mix(keys + mixed[:, row::ROWS] + np.arange(1, bands + 1, dtype=U64))
    low = (mixed & U64((1 << BITS) - 1)).astype(np.uint8)
    packed = (low[:, 0::2] << 4 | low[:, 1::2]).tobytes()
    width = hashes // 2
    sketches: list[bytes | None] = [None] * n
    for k, i in enumerate(full.tolist()):
        sketches[i] = packed[k * width : (k + 1) * width]
    ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()),
            pa.array(sizes),
            pa.array(set_a.view(np.int64)),
            pa.array(set_b.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
            pa.array(sketches, pa.binary()),
        ],
        ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
    )


def signatures(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """Set size, set fingerprint, band keys and b-bit sketch of every document."""
    bands = bands_for(min_percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                yield _sign(part, bands)

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def estimated_similarity(sketches: np.ndarray) -> np.ndarray:
    """Jaccard estimates of all pairs of sketches (rows of 64-bit words), corrected for chance."""
    n, hashes = len(sketches), sketches.shape[1] * (64 // BITS)
    differ = np.zeros((n, n), np.int64)
    for word in range(sketches.shape[1]):
        x = sketches[:, word][:, None] ^ sketches[:, word][None, :]
        x |= x >> U64(2)
        x |= x >> U64(1)
        differ += np.bitwise_count(x & _NIBBLE_ONES)
    chance = 2.0**-BITS
    return ((hashes - differ) / hashes - chance) / (1 - chance)


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = least_labels(linked)
    off = root != np.arange(len(ids))
    return ids[off], ids[root[off]]


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([pair[i] for pair in pairs]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _emit(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for pair in found:
        if len(pair[0]):
            held.append(pair)
            n += len(pair[0])
        if n > 20_000:
            yield _edges(held)
            held, n = [], 0
    if held:
        yield _edges(held)


def _similar_sketches(bar: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for group in runs(batches, ["key", "block_a", "block_b"]):
            ids = group.column("doc_id").to_numpy()
            raw = b"".join(group.column("sketch").to_pylist())
            sketches = np.frombuffer(raw, U64).reshape(len(ids), -1)
            yield _forest(ids, estimated_similarity(sketches) >= bar)

    return lambda batches: _emit(found(batches))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by blocks of a 0/1 matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    step = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        at = slice(*np.searchsorted(column, [low, low + step]))
        matrix = np.zeros((n, step), np.float32)
        matrix[owner[at], column[at] - low] = 1
        common += matrix @ matrix.T
    return common.astype(np.int64)


def _confirmed(min_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for group in runs(batches, ["cluster", "block_a", "block_b"]):
            ids = group.column("doc_id").to_numpy()
            sets: list[np.ndarray] = []
            for batch in group.combine_chunks().to_batches():
                for part in slices(batch, "text", PART_BYTES):
                    value, bounds = shingle_sets(part)
                    sets += [value[low:high] for low, high in zip(bounds, bounds[1:])]
            common, sizes = intersections(sets), np.array([len(s) for s in sets])
            union = sizes[:, None] + sizes[None, :] - common
            yield _forest(ids, (100 * common >= min_percent * union) & (common > 0))

    return lambda batches: _emit(found(batches))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one group next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def candidate_edges(signed: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """Edges ``(a, b)`` whose components hold every pair in a band bucket whose sketches may be similar."""
    full = signed.where("n_shingles > 0")
    banded = full.select("doc_id", F.explode("bands").alias("key"))
    buckets = stored(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "buckets"
    )
    # Read by both branches below, so entries without a partner go through one shuffle only.
    shared = stored(banded.join(buckets.hint("merge"), "key"), "shared")
    small = shared.where(F.col("n") <= BUCKET_CHUNK).select("key", "doc_id")
    sketched = full.select("doc_id", "sketch").join(small.hint("merge"), "doc_id")
    groups = _dealt(
        sketched.select("key", F.lit(0).cast("long").alias("block_a"), F.lit(0).cast("long").alias("block_b"), "doc_id", "sketch"),
        "key",
    )
    compared = groups.mapInArrow(_similar_sketches(sketch_bar(min_percent)), "a long, b long")
    # At most one such bucket in every BUCKET_CHUNK entries; AQE splits its rows in the join.
    large = shared.where(F.col("n") > BUCKET_CHUNK)
    return compared.union(large.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))


def _numbered(members: DataFrame, chunks: str) -> DataFrame:
    return members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col(chunks)))


def _blocks(docs: DataFrame, rows: DataFrame, min_percent: int) -> DataFrame:
    """Links inside each block of ``rows(cluster, block_a, block_b, doc_id)``."""
    texts = docs.join(rows.hint("merge"), "doc_id")
    columns = texts.select("cluster", "block_a", "block_b", "doc_id", "text")
    return _dealt(columns, "cluster", "block_a", "block_b").mapInArrow(_confirmed(min_percent), "a long, b long")


def _chunks_of(members: DataFrame, *by: str) -> DataFrame:
    """Chunks of bounded numbers of documents and shingles for each group of members."""
    by_size = F.greatest(F.ceil(F.count("*") / BLOCK_DOCUMENTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    return members.groupBy(*by).agg(by_size.alias("chunks"))


def confirmed_edges(
    docs: DataFrame, sizes: DataFrame, clusters: DataFrame, min_percent: int = MIN_PERCENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links ``(a, b)`` on full sets inside each chunk and between chunk 0 and the others, all members, their texts."""
    members = clusters.join(sizes.hint("merge"), clusters["id"] == sizes["doc_id"]).select(
        F.col("component").alias("cluster"), "doc_id", "n_shingles"
    )
    numbered = stored(_numbered(members.join(_chunks_of(members, "cluster"), "cluster"), "chunks"), "members")
    last = F.col("chunks") - 1
    # Chunk 0 meets every chunk, itself included where it is the only one.
    others = F.when(F.col("own") == 0, F.sequence(F.least(F.lit(1).cast("long"), last), last)).otherwise(F.array("own"))
    first = numbered.select("cluster", "doc_id", F.lit(0).cast("long").alias("block_a"), F.explode(others).alias("block_b"))
    # All texts are shuffled here only; later comparisons read those of members.
    wanted = numbered.select("doc_id").hint("merge")
    texts = stored(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "texts")
    return _blocks(texts, first, min_percent), numbered, texts


def _outside(members: DataFrame, parts: DataFrame) -> DataFrame | None:
    """Blocks in which the members outside the largest part of each cluster meet all its members, if there are any.

    ``parts(id, component)``: what hangs together so far.
    """
    placed = members.where("chunks > 1").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("part", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    placed = stored(placed.join(largest, "cluster"), "parts")
    outside = placed.where("part <> largest").select("cluster", "doc_id", "n_shingles", "chunks")
    if outside.isEmpty():
        return None
    chunks = _chunks_of(outside, "cluster").select("cluster", F.col("chunks").alias("out_chunks"))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    rest = _numbered(outside.join(chunks, "cluster"), "out_chunks")
    rows = rest.select("cluster", "doc_id", F.col("own").alias("block_a"), each("chunks").alias("block_b"))
    every = placed.join(chunks, "cluster")
    rows = rows.union(every.select("cluster", "doc_id", each("out_chunks").alias("block_a"), F.col("own").alias("block_b")))
    # A member outside that stands in its own partner's chunk too is needed there once.
    return rows.distinct()


def near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents are linked from a similarity of ``min_percent`` hundredths on.
    Null and blank texts have no shingles, are linked with nothing and kept. Rows that
    repeat a ``doc_id`` are one node of the graph. A row with a null id is linked with
    nothing: its component is null and it is kept. Other columns are ignored.
    """
    signed = stored(signatures(docs, min_percent), "signatures")
    known = signed.where("doc_id IS NOT NULL")
    full = known.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"))
    first = classes.select(F.col("first").alias("doc_id")).distinct()
    # Tables of one row a document are joined by sorting at every size: they outgrow any broadcast.
    heads = stored(full.join(first.hint("merge"), "doc_id", "left_semi"), "heads")
    clusters = connected_components(candidate_edges(heads, min_percent))
    sizes = known.select("doc_id", "n_shingles")
    links, members, texts = confirmed_edges(docs, sizes, clusters, min_percent)
    copies = full.join(classes.hint("merge"), ["set_a", "set_b"]).select(
        F.col("doc_id").alias("a"), F.col("first").alias("b")
    )
    components = connected_components(links.union(copies))
    if not members.where("chunks > 1").isEmpty():
        blocks = _outside(members, components)
        if blocks is not None:
            known = components.select(F.col("id").alias("a"), F.col("component").alias("b"))
            components = connected_components(known.union(_blocks(texts, blocks, min_percent)))
    found = signed.join(components.hint("merge"), signed["doc_id"] == components["id"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate component left.

    Of a repeated ``doc_id`` one row stays; rows with a null id all stay. Other columns go
    through by position, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, key = docs.toDF(*names), names[docs.columns.index("doc_id")]
    found = near_duplicates(docs.select("doc_id", "text"), min_percent)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    known = plain.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("kept_id"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    one = known.withColumn("nth", nth).where("nth = 1").drop("nth")
    return one.union(plain.where(F.col(key).isNull())).toDF(*docs.columns)
