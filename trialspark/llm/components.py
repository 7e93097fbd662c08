"""Connected components of a large edge list, by rounds of small forests and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import least_reached
from trialspark.llm.stored import stored

# Edges of which a task makes one forest, about.
PIECE_EDGES = 500_000
# Nodes with more children than this don't meet them in one task.
HOT_EDGES = 1024
# Up to so many parents to jump over are broadcast, so that edges need no shuffle.
FEW_NODES = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id reachable, for every id on an edge ``(a, b)``.

    Edges ``(u, v)`` lead from a child to a smaller parent. Each round joins the parents of
    every child, then moves each edge to its parent's least parent, and the last one leaves
    stars: no child has two parents, and no parent is a child. A node may have any share of
    all edges. Self edges, repeated edges and nulls change nothing; no edges give no rows.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stored(_joined(plain), "edges")
    while True:
        nodes = stored(_notable(current), "nodes")
        between, split = F.expr("children > 0 AND least IS NOT NULL"), F.expr("least < greatest")
        middle, split = nodes.agg(F.count_if(between), F.count_if(split)).first()
        if not middle and not split:
            break
        current = stored(_joined(_jumped(current, nodes, middle)), "edges")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _joined(edges: DataFrame) -> DataFrame:
    """The same components, by forests of a task's edges and then of the edges that share children.

    After the first forest a task has one edge a child at most, so no child has more than one for
    each task in the shuffle.
    """
    first = edges.mapInArrow(_forests, "u long, v long")
    return first.repartition("u").sortWithinPartitions("u").mapInArrow(_forests, "u long, v long")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= PIECE_EDGES:
            # A child's edges stay together where the rows are sorted.
            child, last = np.asarray(batch.column("u")), held[-1].column("u")[-1].as_py()
            cut = batch.num_rows if (child == last).all() else int(np.argmax(child != last))
            held.append(batch.slice(0, cut))
            batch, n = batch.slice(cut), n + cut
            if not batch.num_rows:
                continue
            yield _forest(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield _forest(held)


def _forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Every node of some edges but the least ones, with the least node that it reaches."""
    ends = [np.concatenate([np.asarray(batch.column(side)) for batch in held]) for side in ("u", "v")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = least_reached(len(nodes), *np.split(at, 2))
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], ["u", "v"])


def _notable(edges: DataFrame) -> DataFrame:
    """Nodes that keep ``edges`` from being stars, with their least and greatest parent, and hot parents."""
    none = F.lit(None).cast("long")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("least"), F.col("v").alias("greatest"), F.lit(0).alias("child"))
    ends = ends.union(edges.select(F.col("v").alias("id"), none, none, F.lit(1)))
    nodes = ends.groupBy("id").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("child").alias("children"))
    return nodes.where(f"children > {HOT_EDGES} OR least < greatest OR (children > 0 AND least IS NOT NULL)")


def _jumped(edges: DataFrame, nodes: DataFrame, middle: int) -> DataFrame:
    """Edges moved to the least parent of their parent, where it has one."""
    over = nodes.where("children > 0").select(F.col("id").alias("v"), F.coalesce("least", "id").alias("to"), "children")
    moved = F.coalesce("to", "v").alias("v")
    if middle <= FEW_NODES:
        return edges.join(F.broadcast(over.where("to <> v")), "v", "left").select("u", moved)
    # At most one in HOT_EDGES edges has such a parent.
    hot = F.broadcast(over.where(F.col("children") > HOT_EDGES))
    few = over.where((F.col("children") <= HOT_EDGES) & (F.col("to") < F.col("v")))
    spread = edges.join(hot.select("v"), "v", "left_anti").join(few.hint("merge"), "v", "left")
    return edges.join(hot, "v").select("u", moved).union(spread.select("u", moved))
