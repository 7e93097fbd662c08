"""Name, URL, routing and SQL-extraction rules against literal cases and Python models."""

from __future__ import annotations

import re
import string
from urllib.parse import quote, unquote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trialspark.functions import text as T
from trialspark.functions.numeric import number_from_text, round_scaled

BATCH = settings(
    max_examples=10,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
# No lone surrogates (not storable as UTF-8).
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=25)


def apply(spark: SparkSession, function, values: list) -> list:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in df.orderBy("i").select(function("v")).collect()]


def test_sanitize_name(spark):
    assert apply(spark, T.sanitize_name, ["Test (Project) 1!", "  spaces  ", "a-b_c", "é"]) == [
        "Test_Project_1",
        "spaces",
        "a-b_c",
        "",
    ]


@BATCH
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_sanitize_name_model(spark, names):
    allowed = set(string.ascii_letters + string.digits + "-_ ")
    kept = ("".join(filter(allowed.__contains__, name)).strip(" ") for name in names)
    assert apply(spark, T.sanitize_name, names) == ["_".join(k.split(" ")) for k in kept]


def test_table_name(spark):
    stems = ["data1", "123_data", "My File-v2", "_x", "Été"]
    assert apply(spark, T.table_name, stems) == ["data1", "t_123_data", "my_file_v2", "t__x", "été"]


@BATCH
@given(st.lists(st.text(st.sampled_from("abzAZ09 -_é.("), min_size=1, max_size=12), min_size=1, max_size=20))
def test_table_name_model(spark, stems):
    lowered = [stem.translate(str.maketrans(" -", "__")).lower() for stem in stems]
    model = [("" if name[:1].isalpha() else "t_") + name for name in lowered]
    assert apply(spark, T.table_name, stems) == model


def test_file_stem(spark):
    assert apply(spark, T.file_stem, ["a.csv", "a.b.txt", "none"]) == ["a", "a.b", "none"]


def test_url_file_name(spark):
    urls = {
        "http://x/file%20name.zip": "file name.zip",
        "http://x/dir/": "downloaded_file",
        "http://x/a+b%2Bc": "a+b+c",
        "http://x/q?a=1&b=%C3%A9": "q?a=1&b=é",
        "http://x/100%": "100%",
        "http://x/%zz%41": "%zzA",
    }
    assert apply(spark, T.url_file_name, list(urls)) == list(urls.values())


@BATCH
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_percent_decode_model(spark, texts):
    quoted = [quote(t, safe="+&=?") for t in texts]
    assert apply(spark, T.percent_decode, quoted) == [unquote(q) for q in quoted]


def test_target_file_name(spark):
    urls = ["https://doi.org/10.1/x", "http://doi.org/10.1/x"]
    assert apply(spark, T.target_file_name, urls) == ["dataset_link.txt", "x"]


@BATCH
@given(st.lists(st.text(st.sampled_from(" \t\n\x0b\x1c\x85\xa0 　ab"), max_size=8), min_size=1, max_size=20))
def test_strip_model(spark, texts):
    assert apply(spark, T.strip, texts) == [t.strip() for t in texts]


def test_route_input(spark):
    cases = {
        "": "ignore",
        " \t\n": "ignore",
        "exit": "exit",
        " QUIT ": "exit",
        "exits": "natural_language",
        "SELECT 1": "sql",
        "with x as (select 1) select * from x": "sql",
        "without insulin": "sql",
        "Show tables": "sql",
        "describe t": "sql",
        "PRAGMA x": "sql",
        "-- note\nselect 1": "natural_language",
        "how many kids": "natural_language",
    }
    assert apply(spark, T.route_input, list(cases)) == list(cases.values())


ANSWERS = {
    "```sql\nSELECT 1;\n```": "SELECT 1;",
    "Sure.\n```SQL\nSELECT 1\n```\nDone ```sql\nSELECT 2\n```": "SELECT 1",
    "```duckdb SELECT 1```": "SELECT 1",
    "```text\nSELECT 1\n```": "text\nSELECT 1",
    "``````": "",
    "sql\nSELECT name FROM users;": "SELECT name FROM users;",
    "DuckDB\nSELECT 1": "SELECT 1",
    "SELECT * FROM test;": "SELECT * FROM test;",
    "```sql\nSELECT 1": "sql\nSELECT 1",
    "SELECT 1\n```": "SELECT 1",
}


def test_sql_from_answer(spark):
    assert apply(spark, T.sql_from_answer, list(ANSWERS)) == list(ANSWERS.values())


PIECES = st.lists(
    st.sampled_from(["```", "`", "sql", "duckdb", "SQL", "\n", " ", "SELECT 1", "text", ";"]), max_size=9
).map("".join)


@BATCH
@given(st.lists(PIECES, min_size=1, max_size=40))
def test_sql_from_answer_model(spark, answers):
    """Model: the text cut at its fences."""

    def model(answer: str) -> str:
        text = answer.strip()
        before, opened, rest = text.partition("```")
        block, closed, _ = rest.partition("```")
        if opened and closed:
            return re.sub("(?i)^(sql|duckdb)", "", block).strip()
        return "".join(re.sub("(?i)^(sql|duckdb)\n", "", text).split("```")).strip()

    assert apply(spark, T.sql_from_answer, answers) == [model(a) for a in answers]


CONSOLE = {
    "```sql\nSELECT 1;\n```": "SELECT 1;",
    "```SELECT name FROM users;```": "SELECT name FROM users;",
    "```\nSELECT 1```": "\nSELECT 1",
    "sql\nSELECT 1": "SELECT 1",
    "duckdb\nSELECT 1": "SELECT 1",
    "text ```sql\nSELECT 1\n```": "text ```sql\nSELECT 1\n```",
    "```\nsql\nSELECT 1\n```": "SELECT 1",
}


def test_sql_from_console_answer(spark):
    assert apply(spark, T.sql_from_console_answer, list(CONSOLE)) == list(CONSOLE.values())


@BATCH
@given(st.lists(PIECES, min_size=1, max_size=40))
def test_sql_from_console_answer_model(spark, answers):
    def model(answer: str) -> str:
        text = answer.strip()
        if text[:3] == "```":
            lines = text.split("\n")
            text = "\n".join(lines[1:-1]) if len(lines) > 2 else text.replace("```", "")
        for word in ("sql\n", "duckdb\n"):
            if text[: len(word)].lower() == word:
                return text[len(word) :]
        return text

    assert apply(spark, T.sql_from_console_answer, answers) == [model(a) for a in answers]


def test_round_scaled_keeps_binary_value(spark):
    row = spark.range(1).select(
        round_scaled(F.lit(1.005), 2), round_scaled(F.lit(0.285), 2), round_scaled(F.lit(-2.5), 0)
    ).first()
    assert tuple(row) == (1.0, 0.28, -3.0)


def test_number_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(number_from_text("v")).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(number_from_text("v", strict=True)).collect()
