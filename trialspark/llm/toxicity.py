"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, then a linear classifier.

A feature of the classifier is an n-gram whose ratio is more than ``MARGIN`` standard errors
from none in the training rows; its value is the plain smoothed log-count ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import U64, mix, slices, text_bytes
from trialspark.llm.columns import from_text
from trialspark.llm.hashed_linear import FEATURES, Settings, lists, sampled, sigmoid, sums, train
from trialspark.llm.stored import stored

SIZES = (4, 5)
MARGIN = 3.0
SETTINGS = Settings(n_buckets=1 << 20, l1=0.01)
_PART_BYTES = 1 << 19


@dataclass(frozen=True)
class Model:
    """Informative buckets in order, their log-count ratios and their weights; the bias is last."""

    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray


def grams(batch: pa.RecordBatch, n_buckets: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row and bucket of the distinct n-grams of each text, ordered by row.

    Letters of ASCII and Latin-1 are lower-cased. ``wanted`` (by bucket) drops the others early.
    """
    data, offsets = text_bytes(batch.column("text"))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = lead[offsets]
    char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U64)
    upper = ((char >= 65) & (char <= 90)) | ((char >= 0xC0) & (char <= 0xDE) & (char != 0xD7))
    char = char + U64(32) * upper.astype(U64)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    keys = []
    for size in SIZES:
        n = len(char) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, U64)
        for i in range(size):
            value = value * U64(0x100000001B3) + char[i : i + n]
        bucket = (mix(value) % U64(n_buckets)).astype(np.int64)
        held = owner[:n] == owner[size - 1 :]
        if wanted is not None:
            held &= wanted[bucket]
        keys.append(owner[:n][held] * n_buckets + bucket[held])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key // n_buckets, key % n_buckets


def log_count_ratios(labelled: DataFrame, s: Settings = SETTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell the labels apart, in order, and their smoothed log ratios of document shares."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, s.n_buckets), np.int64)
        for batch in batches:
            for part in slices(batch, "text", _PART_BYTES):
                label = np.asarray(part.column("label"))
                owner, bucket = grams(part, s.n_buckets)
                for side in (0, 1):
                    totals[side] += np.bincount(bucket[label[owner] == side], minlength=s.n_buckets)
        bucket = np.flatnonzero(totals.sum(0))
        columns = [pa.array(bucket), pa.array(totals[0, bucket]), pa.array(totals[1, bucket])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "negative", "positive"])

    n0, n1 = (labelled.where(F.col("label") == side).count() for side in (0, 1))
    counts = (
        labelled.select("label", "text")
        .mapInArrow(count, "bucket long, negative long, positive long")
        .groupBy("bucket")
        .agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    )
    ratio = F.log((F.col("positive") + 1) / (n1 + 2)) - F.log((F.col("negative") + 1) / (n0 + 2))
    error = F.sqrt(1 / (F.col("positive") + 1) + 1 / (F.col("negative") + 1))
    # Packed: the driver gets two arrays of at most ``n_buckets`` numbers, not a row object each.
    rows = counts.where(F.abs(ratio) > MARGIN * error).select("bucket", ratio.alias("ratio")).toArrow()
    order = np.argsort(np.asarray(rows.column("bucket")))
    return np.asarray(rows.column("bucket"))[order], np.asarray(rows.column("ratio"))[order]


def fit(labelled: DataFrame, s: Settings = SETTINGS) -> Model:
    """Model from ``labelled(doc_id, text, label)``, at most about ``s.max_rows`` rows of it.

    Rows without a label or id are left out. Without rows every score is one half.
    """
    known = sampled(labelled.where("label IN (0, 1) AND doc_id IS NOT NULL"), s)
    columns = (F.col("doc_id").cast("long"), F.col("label").cast("int"), "shard", "text")
    rows = stored(known.select(*columns), "labelled")
    buckets, ratios = log_count_ratios(rows, s)
    scaling = labelled.sparkSession.sparkContext.broadcast((buckets, ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PART_BYTES):
                owner, place, amount = _scaled(part, *scaling.value, s.n_buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(name) for name in ("doc_id", "label", "shard")),
                        lists(owner, part.num_rows, place, pa.int32()),
                        lists(owner, part.num_rows, amount, pa.float32()),
                    ],
                    ["doc_id", "label", "shard", "places", "amounts"],
                )

    features = stored(rows.mapInArrow(run, FEATURES), "features")
    return Model(buckets, ratios, train(features, replace(s, n_buckets=len(buckets) + 1)))


def _scaled(part: pa.RecordBatch, buckets: np.ndarray, ratios: np.ndarray, n_buckets: int):
    """Row, place in the model and ratio of each text's informative n-grams, and its bias."""
    wanted = np.zeros(n_buckets, bool)
    wanted[buckets] = True
    owner, bucket = grams(part, n_buckets, wanted)
    place = np.searchsorted(buckets, bucket)
    n = part.num_rows
    owner = np.concatenate((owner, np.arange(n)))
    amount = np.concatenate((ratios[place], np.ones(n)))
    place = np.concatenate((place, np.full(n, len(buckets))))
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order], amount[order]


def score(docs: DataFrame, model: Model, s: Settings = SETTINGS) -> DataFrame:
    """``docs`` with ``score``: chance of label 1. Null and short texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        owner, place, amount = _scaled(part, m.buckets, m.ratios, s.n_buckets)
        return [pa.array(sigmoid(sums(owner, part.num_rows, m.weights[place] * amount)))]

    return from_text(docs, "score double", compute, _PART_BYTES)
