"""As-of joins, episodes and weighted time over many small pieces, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest

from trialspark.operators.sequences import asof_join, episodes, time_weighted_range

START = datetime(2024, 1, 1)
MINUTE = timedelta(minutes=1)
READINGS = "id long, subject string, at timestamp_ntz, value double"


@pytest.fixture(autouse=True)
def small_pieces(spark):
    """Pieces and batches of a few rows, so that runs cross many borders of both kinds."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _readings(seed: int, low: float, n: int = 400) -> list[tuple]:
    """A hot subject holds two thirds of the rows; some rows lack a key, time or value."""
    rng = random.Random(seed)
    rows = []
    for number in range(n):
        subject = rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]) if rng.random() < 0.9 else f"s{number}"
        at = START + rng.randrange(2000) * MINUTE if rng.random() > 0.03 else None
        value = rng.choice([40.0, 50.0]) if rng.random() < low else rng.choice([60.0, 100.0, 200.0, None])
        rows.append((number, subject, at, value))
    return rows


def _usable(rows: list[tuple]) -> list[tuple]:
    kept = [(subject, at, value) for _, subject, at, value in rows if None not in (subject, at, value)]
    return sorted(kept)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("max_gap", [None, 5 * MINUTE])
@pytest.mark.parametrize("share", [0.05, 0.6])
def test_asof_join(spark, forward, max_gap, share):
    rng = random.Random(3)
    rows = _readings(1, 0.5)
    right = [row for row in rows if rng.random() < share]
    left = [row for row in rows if row not in right]
    left += left[:5]
    # Matches are compared by time, as rights with equal keys and times are alike to the join.
    joined = asof_join(
        spark.createDataFrame(left, READINGS), spark.createDataFrame(right, READINGS), ["subject"], "at", "at",
        into="value of", forward=forward, max_gap=max_gap,
    )
    got = sorted((row["id"], row["value of"]["at"] if row["value of"] else None) for row in joined.collect())
    expected = []
    for number, subject, at, _ in left:
        times = [t for _, s, t, _ in right if None not in (subject, at, s, t) and s == subject and (t >= at if forward else t <= at)]
        best = (min if forward else max)(times, default=None)
        if best is not None and max_gap is not None and abs(at - best) > max_gap:
            best = None
        expected.append((number, best))
    assert got == sorted(expected, key=lambda pair: pair[0])
    assert joined.columns == ["id", "subject", "at", "value", "value of"]


def test_asof_join_of_empty_tables_and_several_keys(spark):
    left = spark.createDataFrame([("x", 1, START), ("x", 2, START)], "`a.b` string, k int, at timestamp_ntz")
    right = spark.createDataFrame([("x", 2, START, [1])], "`a.b` string, k int, seen timestamp_ntz, list array<int>")
    none = asof_join(left, right.where("false"), ["a.b", "k"], "at", "seen")
    assert [row["match"] for row in none.collect()] == [None, None]
    assert asof_join(left.where("false"), right, ["a.b", "k"], "at", "seen").count() == 0
    assert asof_join(left.where("false"), right.where("false"), ["a.b", "k"], "at", "seen").count() == 0
    found = {row["k"]: row["match"] for row in asof_join(left, right, ["a.b", "k"], "at", "seen").collect()}
    assert found[1] is None and found[2]["list"] == [1]


@pytest.mark.parametrize("low", [0.5, 0.95, 1.0])
@pytest.mark.parametrize("max_gap", [3, 30, 5000])
def test_episodes(spark, low, max_gap):
    rows = _readings(2, low)
    gap = max_gap * MINUTE
    expected = []
    for subject, group in groupby(_usable(rows), key=lambda row: row[0]):
        run: list[tuple] = []
        for row in [*group, (subject, datetime.max, 1000.0)]:
            if run and (row[2] >= 54 or row[1] - run[-1][1] > gap):
                if run[-1][1] - run[0][1] >= 15 * MINUTE:
                    expected.append((subject, run[0][1], run[-1][1], len(run), min(r[2] for r in run)))
                run = []
            run += [row] if row[2] < 54 else []
    found = episodes(spark.createDataFrame(rows, READINGS), ["subject"], "at", "value", 54, max_gap=gap)
    assert sorted(tuple(row) for row in found.collect()) == sorted(expected)
    assert expected or max_gap == 3


@pytest.mark.parametrize("max_gap", [3, 5000])
def test_time_weighted_range(spark, max_gap):
    rows = _readings(5, 0.3)
    expected = {}
    for subject, group in groupby(_usable(rows), key=lambda row: row[0]):
        readings, shares = list(group), [0.0, 0.0, 0.0]
        for (_, at, value), (_, until, _) in zip(readings, readings[1:]):
            share = 0 if value < 70 else 2 if value > 180 else 1
            shares[share] += min(until - at, max_gap * MINUTE).total_seconds()
        total = sum(shares)
        expected[subject] = (total, *((100 * s / total if total else None) for s in shares))
    found = time_weighted_range(
        spark.createDataFrame(rows, READINGS), ["subject"], "at", "value", max_gap=max_gap * MINUTE
    ).collect()
    assert {row["subject"] for row in found} == set(expected)
    for row in found:
        assert list(row)[1:] == pytest.approx(list(expected[row["subject"]]))


def test_no_readings(spark):
    empty = spark.createDataFrame([], READINGS)
    assert episodes(empty, ["subject"], "at", "value", 54).count() == 0
    assert time_weighted_range(empty, ["subject"], "at", "value").count() == 0
