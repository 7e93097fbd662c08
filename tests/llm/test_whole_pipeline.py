"""The corpus pipeline from end to end against a plain version of its five stages, on planted documents."""

from __future__ import annotations

import random
import re
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

GOOD = [f"{a}{b}" for a in ("river", "stone", "meadow", "harbour", "winter", "garden") for b in "abcdefghijklmnopqrst"]
BAD = [f"{a}{b}" for a in ("click", "jackpot", "cheap", "bonus", "winner", "deal") for b in "abcdefghijklmnopqrst"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def prose(rng: random.Random, words: list[str], n: int) -> list[str]:
    return [rng.choice(words) for _ in range(n)]


def planted() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Documents, their labels and benchmark items; what is planted stands beside each block."""
    rng = random.Random(11)
    texts: list[str | None] = []
    labels = []
    for i in range(240):
        good = i % 4 != 3
        labels.append((i, int(good), 0))
        texts.append(" ".join(prose(rng, GOOD if good else BAD, rng.randint(60, 160))))
    # Exact copies, and copies from below 0.80 up to above 0.85: a new word replaces five of 360 shingles.
    for n_changed in (0, 0, 3, 5, 6, 7, 8, 9, 10):
        words = prose(rng, GOOD, 364)
        texts.append(" ".join(words))
        for at in range(n_changed):
            words[20 + 35 * at] = f"meadow{n_changed}x{at}"
        texts.append(" ".join(words))
    # A chain: neighbours are alike, its ends are not.
    words = prose(rng, GOOD, 364)
    for link in range(4):
        texts.append(" ".join(words))
        for at in range(5):
            words[20 + 60 * at + 8 * link] = f"stone{link}x{at}"
    # Benchmark passages: from a few hit words in a long text to all of a short one.
    items = [(f"b{i}", " ".join(prose(rng, GOOD, 30))) for i in range(6)] + [("short", "Harboura, gardenb winterc!")]
    for number, length in enumerate((20, 200, 600, 1300, 60, 20)):
        around = prose(rng, GOOD, length)
        texts.append(" ".join([*around[: length // 2], items[number][1].upper(), *around[length // 2 :]]))
    texts.append(" ".join([*prose(rng, GOOD, 30), "harboura gardenb winterc", *prose(rng, GOOD, 30)]))
    # Personal data: addresses next to each other, at both ends, and one that is none.
    texts.append(" ".join(["ann@mail.example.org", *prose(rng, GOOD, 50), "b.c+d@x-y.co,e@f.gh"]))
    texts.append(" ".join([*prose(rng, GOOD, 50), "no@address", *prose(rng, GOOD, 50), "z_z@q.io"]))
    # Nothing, blanks, and one very long text with characters beyond ASCII.
    texts += [None, "", " \n\t", " ".join([*prose(rng, GOOD, 20_000), "é ß 😀"])]
    documents = [(i, text, "en", f"s{i % 3}", len(text or "")) for i, text in enumerate(texts)]
    return documents, labels, items


def shingles(text: str | None) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(docs: dict[int, str | None]) -> dict[int, str | None]:
    sets = {i: shingles(text) for i, text in docs.items()}
    leader = {i: i for i in docs}
    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((leader[a], leader[b]))
                leader = {i: low if own == high else own for i, own in leader.items()}
    return {i: docs[i] for i in ids if leader[i] == i}


def contaminated(text: str | None, items: list[tuple]) -> bool:
    def words_of(some: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (some or "").translate(LOWER))

    windows = set()
    for _, item in items:
        words = words_of(item)
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()
    words, hit = words_of(text), set()
    for length in {len(window) for window in windows}:
        for start in range(len(words) - length + 1):
            if tuple(words[start : start + length]) in windows:
                hit |= set(range(start, start + length))
    return bool(hit) and 20 * len(hit) >= len(words)


def masked(text: str | None) -> str:
    return EMAIL.sub("<email>", text or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    documents, labels, items = planted()
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id string, text string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder, documents, labels, items


def test_all_stages_against_plain_versions(spark, tables):
    folder, documents, labels, items = tables
    rejected = {i for i, good, _ in labels if not good}
    docs = {i: text for i, text, *_ in documents if i not in rejected}
    assert len(docs) < len(documents)
    kept = one_of_each_group(docs)
    # 0, 0, 3, 5, 6, 7 and 8 changed words are near copies, 9 and 10 are not; three of the chain go;
    # the two texts of blanks and none have no shingles and all stay.
    assert len(docs) - len(kept) == 7 + 3
    clean = {i: text for i, text in kept.items() if not contaminated(text, items)}
    assert 3 <= len(kept) - len(clean) <= 6
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {}
    for i, text in clean.items():
        ids = model.encode(masked(text), add_bos=True, add_eos=True)
        expected[i] = (len(ids), struct.pack(f"<{len(ids)}I", *ids), model.decode(ids))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == len(expected)
    found = {row["doc_id"]: (row["n_tokens"], bytes(row["ids"]), row["decoded"]) for row in rows}
    assert set(found) == set(expected)
    assert [i for i in expected if found[i] != expected[i]] == []


def test_stages_keep_columns_and_counts_of_characters(spark, tables):
    folder, documents, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[2:4]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
    assert docs.where("n_chars <> length(text)").count() == 0
    originals = {i: text for i, text, *_ in documents}
    assert all(row["text"] == (originals[row["doc_id"]] and masked(originals[row["doc_id"]])) for row in docs.collect())
