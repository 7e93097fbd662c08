"""Hard negatives for anchors, by best-first search in STR-packed R-trees.

1. Vectors are dealt into blocks by ranges of their first coordinate; each block is packed
   into an R-tree by sort-tile-recursive tiling: slabs along the coordinate that varies
   most, each slab tiled along the next one, down to leaves. The leaves are a stored table.
2. A box of least and greatest coordinates bounds the inner products of a query with all
   vectors in it from both sides. Per block and query a priority queue opens boxes by
   their upper bound; boxes outside the query's score window are never opened, and the
   search ends at the first box that can't hold anything before the k-th result so far.
3. The first ``k`` of each block are merged to the first ``k`` of all blocks.

Each group of work is one block with one chunk of queries, both of bounded size, so no
label, vector or anchor can make a group large. All vectors are searched; bounds only skip
what can't be in the result. Positives are searched first, then their scores set the
windows in which negatives are searched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.stored import stored

LEAF_ROWS = 128
FAN_OUT = 16
BLOCK_ROWS = 1 << 16
CHUNK_QUERIES = 1 << 14
# Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)

LEAF_SCHEMA = "block int, dims int, leaf int, ids binary, labels binary, points binary"
FOUND_SCHEMA = "anchor_id long, positive_id long, id long, score long"


@dataclass(frozen=True)
class Settings:
    """Results per anchor and the score window of negatives, in hundredths of the positive's score."""

    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(id, label, point)`` of ``vectors(vec_id, embedding, label)``; point: ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part. Of rows that share an id the one with the least label and point does.
    """
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    # A floor of doubles is a long; adding the remainder keeps numbers beyond its range.
    point = F.transform("embedding", lambda x: x.cast("double") * scale - F.pmod(x.cast("double") * scale, F.lit(1.0)))
    taking_part = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    rows = taking_part.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long"), point.alias("point"))
    least = rows.groupBy("id").agg(F.min(F.struct("label", "point")).alias("least"))
    return least.select("id", "least.label", "least.point")


def str_tiles(points: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows of each leaf: slabs along one coordinate after another, those that vary most first."""
    dims = points.shape[1]
    order = np.argsort(-points.var(0), kind="stable") if dims else np.zeros(0, int)
    tiles: list[np.ndarray] = []

    def tile(rows: np.ndarray, depth: int) -> None:
        if len(rows) <= leaf_rows:
            tiles.append(rows)
            return
        if depth == dims:
            rows = rows[np.argsort(ids[rows], kind="stable")]
            tiles.extend(rows[i : i + leaf_rows] for i in range(0, len(rows), leaf_rows))
            return
        leaves = -(-len(rows) // leaf_rows)
        slabs = int(np.ceil(leaves ** (1 / (dims - depth))))
        size = -(-leaves // slabs) * leaf_rows
        rows = rows[np.lexsort((ids[rows], points[rows, order[depth]]))]
        for i in range(0, len(rows), size):
            tile(rows[i : i + size], depth + 1)

    tile(np.arange(len(points)), 0)
    return tiles


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of this partition's tree, one tree for each number of coordinates."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    block = TaskContext.get().partitionId()
    widths = np.asarray(table.column("dims"))
    for dims in np.unique(widths).tolist():
        part = table.filter(pa.array(widths == dims))
        ids, labels = np.asarray(part.column("id")), np.asarray(part.column("label"))
        points = _matrix(part.column("point"), dims) if dims else np.zeros((len(ids), 0))
        tiles = str_tiles(points, ids)
        for low in range(0, len(tiles), 256):
            some = tiles[low : low + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(some), pa.int32()),
                    pa.array([dims] * len(some), pa.int32()),
                    pa.array(range(low, low + len(some)), pa.int32()),
                    *(pa.array([values[t].tobytes() for t in some], pa.binary()) for values in (ids, labels, points)),
                ],
                ["block", "dims", "leaf", "ids", "labels", "points"],
            )


@dataclass
class Forest:
    """Leaves of packed trees, and the number of their blocks."""

    leaves: DataFrame
    n_blocks: int


def pack(rows: DataFrame) -> Forest:
    """R-trees over ``rows(id, label, point)``, stored leaf by leaf."""
    spark = rows.sparkSession
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    # Ties of the coordinate are split by a hash of the id.
    dealt = rows.withColumn("dims", F.size("point")).repartitionByRange(
        n_blocks, F.try_element_at("point", F.lit(1)), F.xxhash64("id")
    )
    leaves = stored(dealt.mapInArrow(_pack, LEAF_SCHEMA), "rtree-leaves")
    last = leaves.agg(F.max("block")).first()[0]
    return Forest(leaves, 0 if last is None else last + 1)


class Tree:
    """One block's R-tree: boxes level by level from the leaves up, and the leaves' rows."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], points: list[np.ndarray]) -> None:
        self.ids, self.labels, self.points = ids, labels, points
        level = (
            np.stack([p.min(0) for p in points]),
            np.stack([p.max(0) for p in points]),
            np.array([i.min() for i in ids]),
        )
        self.levels = [level]
        while len(level[2]) > FAN_OUT:
            at = np.arange(0, len(level[2]), FAN_OUT)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum), level))
            self.levels.append(level)
        self.reach = max(float(np.abs(p).max(initial=0)) for p in points)

    def first(
        self, query: np.ndarray, label: int, same: bool, but: int, low: float, high: float, k: int
    ) -> list[tuple[int, int]]:
        """``(-score, id)`` of the first ``k`` rows in the window, of the label or (not ``same``) of others."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        exact = float(np.abs(query).sum()) * self.reach < EXACT
        queue: list[tuple] = []

        def push(level: int, begin: int, end: int) -> None:
            lows, highs, ids = (x[begin:end] for x in self.levels[level])
            most = highs @ up + lows @ down
            least = lows @ up + highs @ down
            for i in np.flatnonzero((most >= low) & (least <= high)) if exact else range(len(ids)):
                # Scores above the window don't count, so its end bounds what a box can offer.
                heapq.heappush(queue, (-min(most[i], high) if exact else -high, ids[i], level, begin + int(i)))

        top = len(self.levels) - 1
        push(top, 0, len(self.levels[top][2]))
        best: list[tuple[int, int]] = []
        while queue:
            bound, least_id, level, i = heapq.heappop(queue)
            if len(best) == k and (bound, least_id) > best[-1]:
                break
            if level:
                push(level - 1, i * FAN_OUT, min((i + 1) * FAN_OUT, len(self.levels[level - 1][2])))
                continue
            score = _products(self.points[i], query, exact)
            fits = ((self.labels[i] == label) == same) & (self.ids[i] != but) & (score >= low) & (score <= high)
            found = [(-int(s), int(v)) for s, v in zip(score[fits], self.ids[i][fits])]
            if found:
                best = heapq.nsmallest(k, best + found)
        return best


def _products(points: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return points @ query
    whole = [int(x) for x in query]
    out = [sum(int(x) * y for x, y in zip(row, whole)) for row in points]
    if any(abs(x) >= 1 << 63 for x in out):
        raise OverflowError("an inner product needs more than 64 bits")
    return np.array(out, object)


def _trees(leaves: pa.Table) -> dict[int, Tree]:
    """Trees of a block by their number of coordinates."""
    out: dict[int, list[list[np.ndarray]]] = {}
    rows = leaves.sort_by([("dims", "ascending"), ("leaf", "ascending")]).to_pylist()
    for row in rows:
        ids = np.frombuffer(row["ids"], np.int64)
        points = np.frombuffer(row["points"], np.float64).reshape(len(ids), row["dims"])
        parts = out.setdefault(row["dims"], [[], [], []])
        for held, value in zip(parts, (ids, np.frombuffer(row["labels"], np.int64), points)):
            held.append(value)
    return {dims: Tree(*parts) for dims, parts in out.items()}


def _search(settings: Settings, negatives: bool):
    def run(leaves: pa.Table, queries: pa.Table) -> pa.Table:
        trees = _trees(leaves)
        rows: list[tuple] = []
        for query in queries.to_pylist():
            point = np.array(query["point"], np.float64)
            tree = trees.get(len(point))
            if tree is None:
                continue
            anchor, label = query["anchor_id"], query["label"]
            if not negatives:
                found = tree.first(point, label, True, anchor, -np.inf, np.inf, settings.positives)
                rows += [(anchor, None, i, -s) for s, i in found]
                continue
            for positive in query["positives"]:
                score = positive["score"]
                low = -(-settings.low_percent * score // 100)
                high = settings.high_percent * score // 100
                if low <= high:
                    found = tree.first(point, label, False, anchor, low, high, settings.negatives)
                    rows += [(anchor, positive["id"], i, -s) for s, i in found]
        columns = list(zip(*rows)) or [()] * 4
        names = ["anchor_id", "positive_id", "id", "score"]
        return pa.table([pa.array(column, pa.int64()) for column in columns], names)

    return run


def _first_of(forest: Forest, queries: DataFrame, settings: Settings, negatives: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each query over all blocks, with their ``rank``."""
    n_chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    chunk = F.pmod(F.xxhash64("anchor_id"), F.lit(n_chunks)).cast("int").alias("chunk")
    blocks = F.sequence(F.lit(0), F.lit(max(0, forest.n_blocks - 1)))
    asked = queries.select("*", chunk, F.explode(blocks).alias("block")).groupBy("block", "chunk")
    chunks = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    searched = forest.leaves.select("*", chunks).groupBy("block", "chunk")
    found = searched.cogroup(asked).applyInArrow(_search(settings, negatives), FOUND_SCHEMA)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows(id, label, point)`` with one row per id, as ``usable`` gives. Anchors are the
    rows for which ``is_anchor`` is true. Scores are inner products; higher ones come
    first, ties by smaller id. Only vectors with as many components as the anchor meet it;
    a score beyond 64 bits is an error. An anchor without another row of its label, and a
    positive without a row in its window, give no rows.
    """
    rows = stored(rows.select("id", "label", "point"), "vectors")
    forest = pack(rows)
    anchors = rows.where(is_anchor).select(F.col("id").alias("anchor_id"), "label", "point")
    positives = stored(
        _first_of(forest, anchors, settings, False, settings.positives).select("anchor_id", "id", "score"), "positives"
    )
    lists = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    negatives = _first_of(forest, anchors.join(lists, "anchor_id"), settings, True, settings.negatives)
    scores = positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
