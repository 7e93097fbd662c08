"""Execution accuracy of statement pairs, and mergeable sketches against exact figures."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest

from trialspark.operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    daily_sketches,
    merged_sketches,
    rank_errors,
    sketch_summary,
)
from trialspark.plans import accuracy
from trialspark.plans.accuracy import execution_accuracy


def _verdicts(spark, pairs: list[tuple[str | None, str | None]], **how: int) -> list[str]:
    rows = [(i, *pair) for i, pair in enumerate(pairs)]
    table = spark.createDataFrame(rows, "pair_id long, predicted string, gold string")
    found = {row["pair_id"]: row["verdict"] for row in execution_accuracy(spark, table, **how).collect()}
    assert set(found) == set(range(len(pairs)))
    return [found[i] for i in range(len(pairs))]


def _values(rows: list[tuple]) -> str:
    return "SELECT * FROM VALUES " + ", ".join(f"({', '.join('NULL' if v is None else str(v) for v in r)})" for r in rows)


def test_random_multisets(spark):
    rng = random.Random(3)
    pairs, expected = [], []
    for _ in range(24):
        left = [(rng.choice([1, 2, None]), rng.choice([5, 6])) for _ in range(rng.randint(1, 4))]
        right = rng.sample(left, len(left)) if rng.random() < 0.5 else [(1, 5)] * rng.randint(1, 4)
        pairs.append((_values(left), _values(right)))
        expected.append("equal" if Counter(left) == Counter(right) else "different")
    assert _verdicts(spark, pairs, pairs_per_job=10) == expected
    assert {"equal", "different"} == set(expected)


def test_statements_without_a_result(spark):
    pairs = [
        ("SELECT raise_error('x')", "SELECT 1"),
        ("SELECT 1", "SELECT 1"),
        ("SELECT 1", "SELECT CAST('x' AS INT)"),
        ("SELECT 1 / 0", "SELECT 1 / 0"),
        ("CREATE TABLE t AS SELECT 1", "SELECT 1"),
        (None, "SELECT 1"),
        ("SELECT 1", ""),
        ("SELECT 1; SELECT 2", "SELECT 1"),
        ("SELECT 1, 2", "SELECT 1"),
        ("SELECT '1'", "SELECT 1"),
        ("SELECT 1.0", "SELECT 1"),
        ("SELECT DATE '2024-01-01'", "SELECT TIMESTAMP '2024-01-01 00:00:00'"),
        ("SELECT NULL", "SELECT CAST(NULL AS INT)"),
        ("SELECT double('-0')", "SELECT 0"),
        ("SELECT double('NaN')", "SELECT double('NaN')"),
        ("SELECT map(1, 2, 3, 4)", "SELECT map(3, 4, 1, 2)"),
        ("SELECT array(map(1, 2))", "SELECT array(map(1, 3))"),
        ("SELECT 1 AS a, 1 AS a", "SELECT 1 AS b, 1 AS c"),
    ]
    assert _verdicts(spark, pairs) == [
        "predicted_failed",
        "equal",
        "gold_failed",
        "gold_failed",
        "predicted_failed",
        "predicted_failed",
        "gold_failed",
        "predicted_failed",
        "different",
        "different",
        "equal",
        "equal",
        "equal",
        "equal",
        "equal",
        "equal",
        "different",
        "equal",
    ]


def test_equal_fingerprints_are_compared_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(accuracy, "_tied", lambda seen: True)
    assert _verdicts(spark, [("SELECT 1", "SELECT 2"), ("SELECT 1", "SELECT 1")]) == ["different", "equal"]


def test_no_pairs(spark):
    assert _verdicts(spark, []) == []


READINGS = "arm string, ts timestamp, glucose double, subject long"
QUANTILES = {"median": 0.5, "p95": 0.95}


def _readings(n: int) -> list[tuple]:
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    return [
        (rng.choice(["x", "x", "y", None]), start + datetime.timedelta(minutes=i), rng.gauss(150, 40), rng.randrange(3000))
        for i in range(n)
    ]


def test_merged_days_stay_within_the_stated_errors(spark):
    rows = _readings(30_000)
    readings = spark.createDataFrame(rows, READINGS).repartition(8).cache()
    merged = merged_sketches(daily_sketches(readings, ["arm"], "ts", "glucose", "subject"), "arm")
    summary = sketch_summary(merged, QUANTILES | {"least": 0, "greatest": 1}).cache()
    assert summary.count() == 3
    for row in summary.collect():
        values = sorted(r[2] for r in rows if r[0] == row["arm"])
        assert row["n_readings"] == len(values)
        assert (row["least"], row["greatest"]) == (values[0], values[-1])
        for name, q in QUANTILES.items():
            assert abs(sum(v <= row[name] for v in values) / len(values) - q) <= RANK_ERROR
        exact = len({r[3] for r in rows if r[0] == row["arm"]})
        assert abs(row["n_subjects"] - exact) <= DISTINCT_ERROR * exact
    off = rank_errors(readings, ["arm"], "glucose", summary, QUANTILES).collect()
    assert len(off) == 3 and all(0 <= row[name] <= RANK_ERROR for row in off for name in QUANTILES)
    wrong = summary.withColumn("median", summary["p95"])
    assert all(row["median"] > 0.4 for row in rank_errors(readings, ["arm"], "glucose", wrong, QUANTILES).collect())


def test_sketches_of_odd_readings(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("x", day, None, 1), ("x", None, 1.0, 1), ("x", day, float("nan"), 1), ("y", day, 7.0, None), ("y", day, 7.0, 2)]
    daily = daily_sketches(spark.createDataFrame(rows, READINGS), ["arm"], "ts", "glucose", "subject")
    found = sketch_summary(daily, QUANTILES).collect()
    assert [(r["arm"], r["n_readings"], r["median"], r["n_subjects"]) for r in found] == [("y", 2, 7.0, 1)]
    empty = spark.createDataFrame([], READINGS)
    none = sketch_summary(merged_sketches(daily_sketches(empty, ["arm"], "ts", "glucose", "subject"), "arm"), QUANTILES)
    assert none.count() == 0
    with pytest.raises(Exception, match="missing"):
        daily_sketches(empty, ["missing"], "ts", "glucose", "subject")
