"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.arrays import U64, mix, range_hashes, slices, text_bytes
from trialspark.llm.columns import from_text
from trialspark.llm.hashed_linear import FEATURES, Settings, lists, sampled, sigmoid, sums, train
from trialspark.llm.stored import stored

SETTINGS = Settings(n_buckets=1 << 18)
THRESHOLD = 0.3
# Bytes of text whose words are held at once; features take nearly fifty times that.
PART_BYTES = 1 << 18

# Words are runs of letters, digits and bytes beyond ASCII; runs of other signs are words too.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_TWICE = U64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, ...]:
    """Row, bucket and amount of each word and word pair, ordered by row; bucket 0 is the bias.

    A pair of one word with itself is one common feature, so that repetition is seen
    whatever the word. Amounts are logarithms of counts, scaled to unit length.
    """
    n = len(offsets) - 1
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    text = np.searchsorted(offsets, start, "right") - 1
    word = range_hashes(data, start, end)
    pair = mix(word[:-1] * U64(3) + word[1:])
    pair[word[:-1] == word[1:]] = _TWICE
    near = text[:-1] == text[1:]
    value = np.concatenate((word, pair[near]))
    owner = np.concatenate((text, text[:-1][near]))
    bucket = (value % U64(n_buckets - 1)).astype(np.int64) + 1
    key, count = np.unique(owner * n_buckets + bucket, return_counts=True)
    owner, bucket = key // n_buckets, key % n_buckets
    amount = np.log1p(count)
    length = np.sqrt(sums(owner, n, amount * amount))
    amount = amount / length[owner]
    owner = np.concatenate((owner, np.arange(n)))
    bucket = np.concatenate((bucket, np.zeros(n, np.int64)))
    amount = np.concatenate((amount, np.ones(n)))
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order], amount[order]


def training_rows(labelled: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Hashed features of ``labelled(doc_id, text, label, shard)``, written once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                owner, bucket, amount = features(*text_bytes(part.column("text")), s.n_buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label"),
                        part.column("shard"),
                        lists(owner, part.num_rows, bucket, pa.int32()),
                        lists(owner, part.num_rows, amount, pa.float32()),
                    ],
                    ["doc_id", "label", "shard", "places", "amounts"],
                )

    rows = labelled.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "shard", "text")
    return stored(rows.mapInArrow(run, FEATURES), "features")


def fit(labelled: DataFrame, s: Settings = SETTINGS) -> np.ndarray:
    """Weights from ``labelled(doc_id, text, label)``, at most about ``s.max_rows`` rows of it.

    Rows without a label or id are left out. Without rows every score is one half.
    """
    known = labelled.where("label IS NOT NULL AND doc_id IS NOT NULL")
    return train(training_rows(sampled(known, s), s), s)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``: chance of label 1. Null and blank texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        w = shared.value
        owner, bucket, amount = features(*text_bytes(part.column("text")), len(w))
        return [pa.array(sigmoid(sums(owner, part.num_rows, w[bucket] * amount)))]

    return from_text(docs, "score double", compute, PART_BYTES)
