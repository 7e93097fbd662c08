"""Sparse logistic regression over hashed features, by follow-the-regularised-leader updates.

The training rows lie in shards. In each round every shard runs FTRL-proximal over its
own rows from the common state, as one task, and the driver averages the shards'
states (two numbers per hash bucket, so bounded by the number of buckets).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "doc_id long, label int, shard int, places array<int>, amounts array<float>"


@dataclass(frozen=True)
class Settings:
    """Training parameters. ``max_rows`` bounds the sample of labelled rows that is used."""

    n_buckets: int
    max_rows: int = 16_384
    rows_per_shard: int = 2048
    rounds: int = 3
    passes: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text, by remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def sampled(rows: DataFrame, s: Settings) -> DataFrame:
    """About ``s.max_rows`` rows at most, chosen and dealt to shards by a hash of the id."""
    n = rows.count()
    if n > s.max_rows:
        share = (s.max_rows << 20) // n
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share)
    shards = max(1, min(n, s.max_rows) // s.rows_per_shard)
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """FTRL-proximal weights of a state: zero within the l1 bound."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _shard_update(z: np.ndarray, n: np.ndarray, s: Settings):
    def update(table: pa.Table) -> pa.Table:
        state_z, state_n = z.copy(), n.copy()
        table = table.sort_by("doc_id").combine_chunks()
        labels = table.column("label").to_numpy()
        places, amounts = (table.column(c).combine_chunks() for c in ("places", "amounts"))
        bounds = np.asarray(places.offsets)
        bounds = bounds - bounds[0]
        all_places, all_amounts = places.flatten().to_numpy(), amounts.flatten().to_numpy()
        random = np.random.default_rng(5)
        for i in np.concatenate([random.permutation(len(labels)) for _ in range(s.passes)]):
            at, x = all_places[bounds[i] : bounds[i + 1]], all_amounts[bounds[i] : bounds[i + 1]]
            own_z, own_n = state_z[at], state_n[at]
            w = weights_of(own_z, own_n, s)
            g = (sigmoid(np.dot(w, x)) - labels[i]) * x
            squares = own_n + g * g
            state_z[at] = own_z + g - (np.sqrt(squares) - np.sqrt(own_n)) / s.alpha * w
            state_n[at] = squares
        touched = np.flatnonzero((state_n != n) | (state_z != z))
        changes = np.stack((state_z[touched] - z[touched], state_n[touched] - n[touched]))
        return pa.table(
            {
                "touched": pa.array([touched.astype(np.int32).tobytes()], pa.binary()),
                "changes": pa.array([changes.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    return update


def train(features: DataFrame, s: Settings) -> np.ndarray:
    """Weights by bucket, from rows of ``FEATURES``; all zero without rows."""
    z, n = np.zeros(s.n_buckets), np.zeros(s.n_buckets)
    for _ in range(s.rounds):
        step = _shard_update(z, n, s)
        updates = features.groupBy("shard").applyInArrow(step, "touched binary, changes binary").collect()
        for row in updates:
            touched = np.frombuffer(row["touched"], np.int32)
            changes = np.frombuffer(row["changes"], np.float32).reshape(2, -1)
            z[touched] += changes[0] / len(updates)
            n[touched] += changes[1] / len(updates)
    return weights_of(z, n, s).astype(np.float32)


def lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values ordered by their row number."""
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def sums(owner: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)
