"""Line dedup, fill-in-middle and hard negatives against plain Python, on odd rows too."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from oracle import _rows, connect
from pyspark.sql import functions as F

from trialspark.llm import fill_in_middle, hard_negatives, line_dedup
from trialspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
TEXTS = [
    (1, "Head\n  a b \nÉté\n\ntail"),
    (2, "head \t\nother\nété\nHEAD"),
    (3, "HEAD\r\nÉté\n"),
    (3, "HEAD\r\nÉté\n"),
    (4, None),
    (5, ""),
    (6, "\n\n \t\n"),
    (None, "head"),
    (None, "no break"),
    (7, "x" * 70_000 + "\n" + "😀y\n" * 3 + "<P> marked"),
    (8, "".join(f"line {i}\n" for i in range(40_000))),
    (9, "\n" * 70_000),
    (10, "".join("a" * (i % 5) + "\n" for i in range(60_000))),
]
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_in_middle", "op13_hard_negatives"])
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_queries_match_sql(spark, name, folder):
    found = QUERIES[name](spark, folder)
    result = connect(folder).execute(ORACLES[name])
    columns = [item[0] for item in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, result.fetchall())


# ------------------------------------------------------------------ lines


def plain_lines(rows, min_docs, min_chars=1):
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    split = [(text or "").split("\n") for _, text in rows]
    seen = Counter(k for lines in split for k in {key(line) for line in lines})
    out = []
    for (doc_id, _), lines in zip(rows, split):
        kept = [line for line in lines if len(key(line)) < min_chars or seen[key(line)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize(("min_docs", "min_chars", "batches"), [(2, 1, 4), (3, 1, 1), (1, 4, 3), (5, 1, 7)])
def test_frequent_lines_go(spark, min_docs, min_chars, batches):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    found = line_dedup.without_frequent_lines(docs, min_docs, min_chars, batches)
    rows = found.select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, rows)) == plain_lines(TEXTS, min_docs, min_chars)


def test_frequent_lines_with_odd_columns_and_no_rows(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).select(
        F.lit(1).alias("h1"), "text", F.lit("x").alias("kept"), "doc_id", F.lit(2).alias("a`b.c"), F.lit(3).alias("lines")
    )
    found = line_dedup.without_frequent_lines(docs, 2)
    assert found.columns == ["h1", "text", "doc_id", "a`b.c", "lines", "n_lines", "n_dropped", "kept"]
    assert found.count() == len(TEXTS)
    assert line_dedup.without_frequent_lines(docs.limit(0), 2).count() == 0


def test_light_keys_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = line_dedup.without_frequent_lines(spark.createDataFrame(TEXTS, SCHEMA), 2).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows) == plain_lines(TEXTS, 2)


def test_runs_settle_and_compact(spark):
    def keys(*pairs):
        return spark.createDataFrame([(h, h, n) for h, n in pairs], "h1 long, h2 long, n long")

    runs = line_dedup.LineRuns(spark, 3)
    for batch in (keys((1, 2), (2, 5)), keys((1, 1), (2, 4), (3, 1)), keys((3, 1), (1, 9)), keys((3, 1)), keys()):
        runs.add(batch)
    assert [run is not None for run in runs.levels] == [True, False, True]
    found = runs.frequent()
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3), (2, 2, 5), (3, 3, 3)]
    plan = runs.levels[2].join(runs.levels[0].hint("merge"), line_dedup.KEY, "left_anti")._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    runs.forget()


def test_line_queries_use_no_python_workers(spark):
    plan = QUERIES["op11_line_dedup"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------- cuts


def plain_cut(doc_id, text, settings=fill_in_middle.Settings()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in settings.marks) or h[2] % 100 >= settings.cut_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    p, s, m = settings.marks
    if h[3] % 100 < settings.spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


MORE_TEXTS = TEXTS + [(100 + i, "ab\ncd é<\nP>x <S\n\n" * (i % 7)) for i in range(60)]


@pytest.mark.parametrize("settings", [fill_in_middle.Settings(), fill_in_middle.Settings("s", 60, 30, "[pre]", "[suf]", "[mid]")])
def test_cuts_and_restored_texts(spark, settings):
    docs = spark.createDataFrame(MORE_TEXTS, SCHEMA)
    found = fill_in_middle.cut(docs, settings)
    back = fill_in_middle.restored(F.col("output"), F.col("form"), settings).alias("back")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = found.select(*columns, back, "text").collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(plain_cut(*row, settings) for row in MORE_TEXTS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all(r["back"] == (r["text"] or "") for r in rows)


def test_cuts_with_odd_columns_and_no_rows(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).select("text", F.lit(1).alias("n"), "doc_id", F.lit(2).alias("cuts"), F.lit(0).alias("a`.b"))
    found = fill_in_middle.cut(docs)
    assert found.columns == ["text", "doc_id", "cuts", "a`.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert found.count() == len(TEXTS)
    assert fill_in_middle.cut(docs.limit(0)).count() == 0


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_in_middle.Settings("7", 100, 50, *marks)


@pytest.mark.parametrize(
    "values",
    [
        [0],
        [0, 5, 70_000, 70_001, 200_000],
        list(range(65_530, 65_545)),
        list(range(0, 131_072, 3)),
        list(range(200_000)),
        list(range(0, 9_000, 2)) + list(range(60_000, 140_000)) + [1 << 33],
    ],
)
def test_boundary_sets_select_every_rank(values):
    held = fill_in_middle.BoundarySet(np.array(values))
    assert len(held) == len(values)
    assert [held.select(k) for k in range(0, len(values), max(1, len(values) // 5000))] == values[:: max(1, len(values) // 5000)]


def test_containers_are_the_smallest():
    kinds = [fill_in_middle.container(np.array(v)) for v in (range(0, 100, 7), range(0, 60_000, 3), range(5_000))]
    assert [type(kind).__name__ for kind in kinds] == ["ArrayContainer", "BitmapContainer", "RunContainer"]


# -------------------------------------------------------------- negatives


def plain_negatives(rows, is_anchor, settings):
    out = []
    for anchor, label, point in rows:
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(int(a) * int(b) for a, b in zip(point, p)), i, lab)
            for i, lab, p in rows
            if i != anchor and len(p) == len(point)
        ]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[: settings.positives]:
            window = [
                (s, i)
                for s, i, lab in scored
                if lab != label and settings.low_percent * -score <= 100 * -s <= settings.high_percent * -score
            ]
            for rank, (s, i) in enumerate(sorted(window)[: settings.negatives], 1):
                out.append((anchor, positive, rank, i, -score, -s))
    return Counter(out)


def _mined(spark, rows, settings=hard_negatives.Settings()):
    df = spark.createDataFrame(rows, "id long, label long, point array<double>")
    return Counter(map(tuple, hard_negatives.mine(df, F.col("id") % 10 == 0, settings).collect()))


def test_negatives_match_brute_force_with_ties(spark):
    random = np.random.default_rng(3)
    # Few values and a third of all vectors alike: most scores tie.
    rows = [(i, int(random.integers(3)), [float(x) for x in random.integers(-3, 4, 6)]) for i in range(700)]
    rows += [(1000 + i, i % 3, [1.0, 2.0, 0.0, -1.0, 3.0, 1.0]) for i in range(350)]
    rows += [(5000, 0, [1.0, 2.0]), (5001, 0, [2.0, 1.0]), (5002, 1, [1.0, 1.0]), (5010, 0, []), (5011, 0, []), (5020, 9, [5.0])]
    settings = hard_negatives.Settings(low_percent=-50, high_percent=100)
    for s in (hard_negatives.Settings(), settings, hard_negatives.Settings(2, 300, 0, 80)):
        assert _mined(spark, rows, s) == plain_negatives(rows, lambda i: i % 10 == 0, s)


def test_negatives_beyond_exact_doubles(spark):
    rows = [(i, i % 2, [float((i * 7919) % 1000003 + 2**27), float(2**28 - i)]) for i in range(60)]
    s = hard_negatives.Settings(3, 5, 10, 100)
    assert _mined(spark, rows, s) == plain_negatives(rows, lambda i: i % 10 == 0, s)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (1, [0.5, -0.251], 1), (2, None, 1), (3, [0.5, None], 1), (4, [nan, 0.0], 1), (5, [0.0, -inf], 1), (6, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (7, [0.3, 0.1], 2), (7, [0.2, 0.1], 2), (7, [0.2, 0.1], 2), (8, [], 3),
    ]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    rows = sorted((r["id"], r["label"], r["point"]) for r in hard_negatives.usable(df).collect())
    assert rows == [(1, 1, [128.0, -65.0]), (7, 2, [51.0, 25.0]), (8, 3, [])]
    assert hard_negatives.mine(hard_negatives.usable(df.limit(0)), F.lit(True)).count() == 0


def test_trees_skip_boxes():
    random = np.random.default_rng(5)
    points = np.floor(random.normal(0, 40, (4096, 3)))
    ids = np.arange(4096)
    tiles = hard_negatives.str_tiles(points, ids, 32)
    assert sorted(np.concatenate(tiles).tolist()) == ids.tolist() and max(map(len, tiles)) <= 32
    tree = hard_negatives.Tree([ids[t] for t in tiles], [ids[t] % 2 for t in tiles], [points[t] for t in tiles])
    opened = []
    products = hard_negatives._products
    hard_negatives._products = lambda p, q, exact: opened.append(1) or products(p, q, exact)
    try:
        found = tree.first(points[7], 1, True, 7, -np.inf, 9000.0, 10)
    finally:
        hard_negatives._products = products
    scores = points @ points[7]
    want = sorted((-s, i) for s, i in zip(scores, ids) if i % 2 and i != 7 and s <= 9000)[:10]
    assert found == [(int(s), int(i)) for s, i in want]
    assert len(opened) < len(tiles) // 2
