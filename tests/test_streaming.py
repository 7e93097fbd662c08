"""Incremental loads and late readings: several runs, failures between them, odd files."""

from __future__ import annotations

import datetime
from collections import Counter

import pytest

from trialspark.streaming.batch_log import BatchLog
from trialspark.streaming.late_readings import current_daily_range, daily_range_counts, update_daily_range
from trialspark.streaming.loads import load_new_files


class Broken(RuntimeError):
    pass


def _put(folder, name: str, text: str, encoding: str = "utf-8") -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def _keys(table) -> Counter:
    return Counter(row["k"] for row in table.collect())


def test_second_run_loads_new_files_only(spark, tmp_path):
    source, root = tmp_path / "in", f"{tmp_path}/table"
    _put(source, "a.csv", "k,v\n1,x\n2,y\n")
    assert _keys(load_new_files(spark, str(source), root)) == Counter([1, 2])
    assert BatchLog(spark, root).batches() == [0]
    assert _keys(load_new_files(spark, str(source), root)) == Counter([1, 2])
    assert BatchLog(spark, root).batches() == [0]
    _put(source, "b.csv", "k,v\n3,z\n1,x\n")
    table = load_new_files(spark, str(source), root)
    assert _keys(table) == Counter([1, 2, 3, 1])
    assert {row["k"] for row in table.where("batch = 1").collect()} == {1, 3}
    assert {row["_source"].rsplit("/", 1)[-1] for row in table.where("batch = 1").collect()} == {"b.csv"}


@pytest.mark.parametrize("when", ["before", "half_written", "after"])
def test_failed_batch_is_loaded_once(spark, tmp_path, monkeypatch, when):
    source, root = tmp_path / "in", f"{tmp_path}/table"
    _put(source, "a.csv", "k\n1\n")
    load_new_files(spark, str(source), root)
    _put(source, "b.csv", "k\n2\n")
    write = BatchLog.write

    def failing(log, rows, batch):
        if when == "after":
            write(log, rows, batch)
        elif when == "half_written":
            write(log, rows.union(rows), batch)
            (tmp_path / f"table/batches/batch={batch}/_SUCCESS").unlink()
        raise Broken(when)

    monkeypatch.setattr(BatchLog, "write", failing)
    with pytest.raises(Exception, match=when):
        load_new_files(spark, str(source), root)
    expected = [1, 2] if when == "after" else [1]
    assert _keys(BatchLog(spark, root).read()) == Counter(expected)
    monkeypatch.setattr(BatchLog, "write", write)
    assert _keys(load_new_files(spark, str(source), root)) == Counter([1, 2])


def test_later_files_lose_nothing(spark, tmp_path):
    source, root = tmp_path / "in", f"{tmp_path}/table"
    _put(source, "a.txt", "k|day|name\n1|2024-01-31|a\n")
    load_new_files(spark, str(source), root)
    _put(source, "b.txt", "k|day|name\nseven|2024-02-30|b\n8|2024-02-28|c\n9|2024-02-28\n")
    rows = {row["name"]: row for row in load_new_files(spark, str(source), root).collect() if not row["_malformed"]}
    assert [(item["column"], item["text"]) for item in rows["b"]["_misfits"]] == [("k", "seven"), ("day", "2024-02-30")]
    assert rows["b"]["k"] is None and rows["b"]["day"] is None
    assert rows["c"]["k"] == 8 and rows["c"]["_misfits"] is None
    assert rows["a"]["day"] == datetime.date(2024, 1, 31)
    malformed = load_new_files(spark, str(source), root).where("_malformed IS NOT NULL").collect()
    assert [row["_malformed"] for row in malformed] == ["9|2024-02-28"]


def test_utf16_quotes_and_empty_files(spark, tmp_path):
    source, root = tmp_path / "in", f"{tmp_path}/table"
    source.mkdir()
    assert load_new_files(spark, str(source), root) is None
    _put(source, "a.csv", "")
    assert load_new_files(spark, str(source), root) is None
    _put(source, "b.csv", '﻿k\tname\r\n1\t"á ""x"""\r\n', "utf-16-le")
    _put(source, "c.csv", "﻿k\tname\r\n2\tö\r\n", "utf-16-le")
    table = load_new_files(spark, str(source), root)
    assert {(row["k"], row["name"]) for row in table.collect()} == {(1, 'á "x"'), (2, "ö")}


def test_files_with_headers_only(spark, tmp_path):
    source, root = tmp_path / "in", f"{tmp_path}/table"
    _put(source, "a.csv", "k,v\n")
    table = load_new_files(spark, str(source), root)
    assert table.count() == 0 and table.columns[:2] == ["k", "v"]


SCHEMA = "subject string, ts timestamp, glucose double"


def _at(day: int, hour: int = 0) -> datetime.datetime:
    return datetime.datetime(2024, 1, day, hour)


def _deliver(spark, folder: str, log: BatchLog, rows: list[tuple]):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return update_daily_range(stream, log, ["subject"], "ts", "glucose", "2 days")


def test_late_readings_change_their_day(spark, tmp_path):
    folder, log = f"{tmp_path}/in", BatchLog(spark, f"{tmp_path}/log")
    deliveries = [
        [("a", _at(1, 1), 60.0), ("a", _at(1, 2), 100.0), (None, _at(1), 70.0), ("a", _at(2), None), ("a", None, 9.0)],
        [("a", _at(3, 5), 181.0), ("a", _at(1, 3), 200.0), ("b", _at(2, 1), 180.0)],
        [("a", _at(3, 5), 181.0), ("b", _at(2, 23), 30.0)],
    ]
    for rows in deliveries:
        assert _deliver(spark, folder, log, rows).n_too_late == 0
    found = {(row["day"].day, row["subject"]): row for row in current_daily_range(log, ["subject"]).collect()}
    whole = daily_range_counts(spark.createDataFrame(sum(deliveries, []), SCHEMA), ["subject"], "ts", "glucose")
    rows = whole.collect()
    assert len(rows) == len(found) == 4
    for row in rows:
        ours = found[row["day"].day, row["subject"]]
        assert ours["n_readings"] == row["n_readings"]
        for name in ("below", "in_range", "above"):
            assert ours[f"pct_{name}"] == pytest.approx(100 * row[f"n_{name}"] / row["n_readings"])


def test_too_late_readings_are_counted(spark, tmp_path):
    folder, log = f"{tmp_path}/in", BatchLog(spark, f"{tmp_path}/log")
    _deliver(spark, folder, log, [("a", _at(1), 60.0), ("a", _at(20), 60.0)])
    progress = _deliver(spark, folder, log, [("a", _at(1, 1), 60.0), ("a", _at(20, 1), 60.0)])
    assert progress.n_too_late == 1 and progress.n_rows == 2
    found = {row["day"].day: row["n_readings"] for row in current_daily_range(log, ["subject"]).collect()}
    assert found == {1: 1, 20: 2}
