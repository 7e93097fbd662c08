"""Rounds of connected components over many partitions, and memory of text features."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trialspark.llm import components, near_dedup, quality
from trialspark.llm.arrays import least_reached, slices, text_bytes


def reached(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in list(parent)}


@pytest.fixture
def spread(spark):
    """Shuffles of 8 partitions that stay apart, so that no task sees a whole graph."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize(("few", "hot"), [(50_000, 1024), (0, 2)])
def test_components_over_many_partitions(spread, monkeypatch, few, hot):
    monkeypatch.setattr(components, "FEW_NODES", few)
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    some = random.Random(5)
    path = some.sample(range(10_000), 60)
    edges = list(zip(path, path[1:])) + [(20_000 + some.randrange(80), 20_000 + some.randrange(80)) for _ in range(50)]
    edges += [(30_000 + i, 29_999) for i in range(200)] + [(40_000, 30_000 + i) for i in range(0, 200, 9)]
    rows = components.connected_components(spread.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    ends = {a for a, b in edges if a != b} | {b for a, b in edges if a != b}
    assert sorted(map(tuple, rows)) == sorted((x, low) for x, low in reached(edges).items() if x in ends)


def test_components_of_stars_take_one_round(spark):
    edges = spark.createDataFrame([(1000 + i, i % 7) for i in range(100)], "a long, b long")
    spark.sparkContext.setJobGroup("stars", "stars")
    components.connected_components(edges)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stars")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8


def test_forests_cut_between_children(monkeypatch):
    monkeypatch.setattr(components, "PIECE_EDGES", 4)
    child = np.repeat(np.arange(10, 20), 3)
    parent = np.arange(30) % 5
    batches = [pa.RecordBatch.from_arrays([pa.array(child[i : i + 2]), pa.array(parent[i : i + 2])], ["u", "v"]) for i in range(0, 30, 2)]
    out = [set(batch.column("u").to_pylist()) & set(child.tolist()) for batch in components._forests(iter(batches))]
    assert len(out) > 1 and sum(map(len, out)) == len(set.union(*out)) == 10
    assert least_reached(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_features_hold_little_memory():
    text = " ".join(f"w{i % 7919}x{i % 13}" for i in range(400_000))
    texts = pa.array([text[i : i + 20_000] for i in range(0, len(text), 20_000)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for part_bytes, work in (
        (quality.PART_BYTES, lambda part: quality.features(*text_bytes(part.column("text")), 1 << 18)),
        (near_dedup.PART_BYTES, near_dedup.shingle_sets),
    ):
        tracemalloc.start()
        for part in slices(batch, "text", part_bytes):
            work(part)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 << 20, peak
