"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.arrays import U64, slices, text_bytes
from trialspark.llm.columns import from_text

PROFILE_SIZE = 300
SIZES = (1, 2, 3)
MAX_ROWS_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 2_000
UNDETERMINED = "und"
_PART_BYTES = 1 << 19


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter by code point; 1, the word border, for anything else."""
    table = np.ones(0x110000, np.uint64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = (ord(low) if len(low) == 1 else point) + 2
    return table


def grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text (code points), most frequent first, ties by code, with counts."""
    padded = np.concatenate((np.ones(1, U64), _letters()[text], np.ones(1, U64)))
    border = padded == 1
    char = padded[np.concatenate(([True], ~(border[1:] & border[:-1])))]
    codes = [char[char > 1]]
    for size in SIZES[1:]:
        code = np.zeros(max(len(char) - size + 1, 0), U64)
        for i in range(size):
            code = code << U64(21) | char[i : i + len(code)]
        codes.append(code)
    if not len(codes[0]):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    order = np.argsort(-count, kind="stable")
    return code[order], count[order]


def _texts(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(part.column("text"))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    for low, high in zip(lead, lead[1:]):
        yield points[low:high]


@dataclass(frozen=True)
class Profiles:
    """Languages, all their n-grams in order, and each n-gram's rank in each language's profile."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> Profiles:
    """Profiles from ``labelled(doc_id, text, lang)``, about ``max_rows`` texts of a language at most.

    Counts are folded in each task and by language and n-gram before ranking. Rows without
    a language or text are left out; no rows give no profiles.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [row["lang"] for row in sizes]
    if not languages:
        return Profiles([], np.zeros(0, U64), np.zeros((0, 0), np.int32))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    # At most MAX_LANGUAGES rows, so that no text is shuffled by its language.
    shares = F.broadcast(labelled.sparkSession.createDataFrame(sizes, "lang string, n long"))
    chosen = known.join(shares, "lang").where(place < F.lit(max_rows << 20) / F.col("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                langs = part.column("lang").to_pylist()
                by_lang: dict[str, list] = {}
                for lang, text in zip(langs, _texts(part)):
                    by_lang.setdefault(lang, []).append(grams(text))
                for lang, found in by_lang.items():
                    code, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    total = np.bincount(inverse, np.concatenate([f[1] for f in found]), len(code))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(code), pa.string()),
                            pa.array(code.view(np.int64)),
                            pa.array(total.astype(np.int64)),
                        ],
                        ["lang", "code", "n"],
                    )

    counts = (
        chosen.select("lang", "text")
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE_SIZE)
    rows = ranked.select("lang", "code", "rank").collect()
    codes = np.unique(np.array([r["code"] for r in rows], np.int64).view(U64))
    ranks = np.full((len(codes), len(languages)), -1, np.int32)
    at = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        ranks[np.searchsorted(codes, U64(r["code"])), at[r["lang"]]] = r["rank"] - 1
    return Profiles(languages, codes, ranks)


def closest(text: np.ndarray, profiles: Profiles) -> tuple[str, float]:
    """Language with the least out-of-place distance (the first by name of equals), and its closeness."""
    code = grams(text)[0][:PROFILE_SIZE]
    if not len(code) or not len(profiles.codes):
        return UNDETERMINED, 0.0
    at = np.minimum(np.searchsorted(profiles.codes, code), len(profiles.codes) - 1)
    rank = np.where((profiles.codes[at] == code)[:, None], profiles.ranks[at], -1)
    apart = np.abs(rank - np.arange(len(code))[:, None])
    distance = np.where(rank < 0, PROFILE_SIZE, apart).sum(0)
    best = int(distance.argmin())
    return profiles.languages[best], float(1 - distance[best] / (PROFILE_SIZE * len(code)))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Texts that are null or have no letter get ``und`` and 0, and so do all if there is no profile.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = [closest(text, shared.value) for text in _texts(part)]
        langs, scores = zip(*found) if found else ((), ())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return from_text(docs, "lang_pred string, score double", compute, _PART_BYTES)
