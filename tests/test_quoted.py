"""Splitting quoted records into byte blocks: the same records whatever the block size."""

from __future__ import annotations

import csv
import io
import random

import duckdb
import pytest

from trialspark.sources import quoted
from trialspark.sources.delimited import read_delimited
from trialspark.sources.quoted import Marks, find_blocks, quoted_records

COMMA = Marks(",", '"', '"', False)


def records(spark, path, marks, header=False):
    return sorted(r["line"] for r in quoted_records(spark, find_blocks(spark, str(path), marks), header).collect())


def random_rows(seed: int, n: int) -> list[list[str]]:
    pick = random.Random(seed)
    pieces = ['"', "\n", ",", "é", "x", "word ", "\r\n", '""', "\\", "'", "😀"]
    return [
        ["".join(pick.choice(pieces) for _ in range(pick.choice([0, 1, 3, 30]))) for _ in range(3)]
        for _ in range(n)
    ]


def written(rows: list[list[str]], line_end: str = "\n") -> str:
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line_end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("block", [8, 50, 1000, 1 << 20])
@pytest.mark.parametrize("wide", [False, True])
def test_blocks_of_any_size_give_the_same_records(spark, tmp_path, monkeypatch, block, wide):
    monkeypatch.setattr(quoted, "BLOCK_BYTES", block)
    rows = random_rows(3, 25)
    (tmp_path / "t.csv").write_bytes(written(rows).encode("utf-16" if wide else "utf-8"))
    found = records(spark, tmp_path / "t.csv", Marks(",", '"', '"', wide))
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in found] == sorted(
        rows, key=lambda row: written([row])[:-1]
    )


MALFORMED = {
    "stray_quote": ('a,5" pipe,b\nc,d,e\n', ['a,5" pipe,b', "c,d,e"]),
    "text_after_quote": ('"a" x,"b\nc" d"e,f\ng\n', ['"a" x,"b\nc" d"e,f', "g"]),
    "never_closed": ('a,b\n"c,d\ne\nf', ["a,b", '"c,d\ne\nf']),
    "blank_lines": ('\n\na\n\n"\n\n"\n', ["a", '"\n\n"']),
    "windows": ('a,"b\r\nc"\r\nd,e\r\n', ['a,"b\r\nc"', "d,e"]),
    "no_last_end": ('a,"b\n', ['a,"b\n']),
}


@pytest.mark.parametrize("name", MALFORMED)
@pytest.mark.parametrize("block", [2, 5, 1 << 20])
def test_odd_quotes(spark, tmp_path, monkeypatch, name, block):
    monkeypatch.setattr(quoted, "BLOCK_BYTES", block)
    text, wanted = MALFORMED[name]
    (tmp_path / "t.csv").write_bytes(text.encode())
    assert records(spark, tmp_path / "t.csv", COMMA) == sorted(wanted)


def test_backslash_escapes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "BLOCK_BYTES", 4)
    (tmp_path / "t.csv").write_text('1|"a \\" b\nc"|2\n3|"d\\\\"|4\n')
    found = records(spark, tmp_path / "t.csv", Marks("|", '"', "\\", False))
    assert found == ['1|"a \\" b\nc"|2', '3|"d\\\\"|4']


def test_header_of_every_part_goes(spark, tmp_path):
    for part in "ab":
        (tmp_path / f"part-{part}").write_text(f'\ufeffid,"te\nxt"\n{part},1\n')
    assert records(spark, tmp_path, COMMA, header=True) == ["a,1", "b,1"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "BLOCK_BYTES", 1 << 14)
    rows = [[str(i), f"text {i}\nwith, \"quotes\" and é\r\n" * (i % 5), str(i / 4)] for i in range(4000)]
    path = tmp_path / "t.csv"
    path.write_text(written([["id", "text", "value"], *rows]), newline="")
    df = read_delimited(spark, str(path))
    assert df.rdd.getNumPartitions() > 8
    wanted = duckdb.connect().execute(f"SELECT * FROM read_csv('{path}', auto_detect=true)").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(wanted)


def test_files_with_bare_returns_take_the_whole_file_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'a,b\r"x\ry",1\r')
    assert find_blocks(spark, str(tmp_path / "t.csv"), COMMA) is None
