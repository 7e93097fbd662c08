"""Catalog listings, schema texts, guarded SQL, paging, records."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from trialspark.operators import paging
from trialspark.plans import catalog
from trialspark.plans.sql import NotReadOnly, run_sql
from trialspark.types import display_name


@pytest.fixture
def tables(spark):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string")
    empty = spark.createDataFrame([], "patient_id int, age int, hba1c double")
    return {"users": users, "demographics": empty}


def test_listings(spark, tables):
    assert [r[0] for r in catalog.list_tables(spark, tables).collect()] == ["demographics", "users"]
    listing = {r["name"]: [tuple(c) for c in r["columns"]] for r in catalog.schema_listing(spark, tables).collect()}
    assert listing == {
        "demographics": [("patient_id", "INTEGER"), ("age", "INTEGER"), ("hba1c", "DOUBLE")],
        "users": [("id", "INTEGER"), ("name", "VARCHAR")],
    }
    counted = {r["table_name"]: (r["column_count"], r["row_count"]) for r in catalog.catalog_tables(spark, tables).collect()}
    assert counted == {"demographics": (3, 0), "users": (2, 2)}


def test_schema_texts(spark, tables):
    texts = {r["table_name"]: r["text"] for r in catalog.schema_text(spark, tables, {"users": ["id"]}).collect()}
    assert texts["users"] == "Table: users\nColumns: id (INTEGER), name (VARCHAR)\nSample row: (1, 'Alice')"
    assert texts["demographics"].endswith("Sample row: (empty table)")
    joined = catalog.joined_schema_text(catalog.schema_text(spark, tables, {"users": ["id"]})).first()[0]
    assert joined == texts["demographics"] + "\n\n" + texts["users"]
    bullets = {r["table_name"]: r["text"] for r in catalog.schema_bullets(spark, tables).collect()}
    assert bullets["demographics"] == (
        "Table: demographics\nColumns:\n- patient_id (INTEGER)\n- age (INTEGER)\n- hba1c (DOUBLE)\n"
    )


def test_unreadable_table_does_not_hide_others(spark, tables, tmp_path):
    path = str(tmp_path / "gone")
    spark.range(3).write.parquet(path)
    gone = spark.read.parquet(path)
    for file in (tmp_path / "gone").iterdir():
        file.unlink()
    texts = {r["table_name"]: r["text"] for r in catalog.schema_text(spark, {**tables, "gone": gone}).collect()}
    assert texts["gone"].endswith("Sample row: (could not fetch)")
    assert "Alice" in texts["users"] or "Bob" in texts["users"]


def test_database_tables(spark, tables):
    spark.sql("CREATE DATABASE cat_test")
    tables["users"].write.saveAsTable("cat_test.users")
    tables["users"].createOrReplaceTempView("cat_view")
    try:
        found = catalog.database_tables(spark, "cat_test")
        assert {"users", "cat_view"} <= set(found)
        assert found["users"].count() == 2
    finally:
        spark.catalog.dropTempView("cat_view")
        spark.sql("DROP DATABASE cat_test CASCADE")


def test_display_names(spark):
    df = spark.sql(
        "SELECT true a, 1L b, cast(1 as decimal(38,0)) c, cast(1 as decimal(9,2)) d, array(1.5f) e, "
        "map('k', 1) f, named_struct('x', date'2020-01-01') g, timestamp_ntz'2020-01-01' h, "
        "timestamp'2020-01-01' i, X'00' j, null k, 1Y l, 1S m"
    )
    assert [display_name(f.dataType) for f in df.schema] == [
        "BOOLEAN", "BIGINT", "HUGEINT", "DECIMAL(9,2)", "FLOAT[]", "MAP(VARCHAR, INTEGER)",
        "STRUCT(x DATE)", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "BLOB", "NULL", "TINYINT", "SMALLINT",
    ]


@pytest.fixture
def users_view(spark, tables):
    spark.sql("CREATE TABLE guarded AS SELECT 1 AS id")
    tables["users"].createOrReplaceTempView("users")
    yield
    spark.catalog.dropTempView("users")
    spark.sql("DROP TABLE IF EXISTS guarded")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM users",
        "select id, name from users order by id -- all",
        "-- note\n/* more */ SELECT * FROM users; -- done\n",
        "WITH u AS (SELECT * FROM users) SELECT * FROM u;",
        "TABLE users",
        "FROM users SELECT *",
        "SELECT * FROM users WHERE name <> ';'",
    ],
)
def test_queries_run(spark, users_view, text):
    assert run_sql(spark, text).count() == 2


def test_other_reads(spark, users_view):
    assert run_sql(spark, "SHOW TABLES").count() >= 2
    assert [r["col_name"] for r in run_sql(spark, "DESCRIBE users").collect()] == ["id", "name"]
    assert run_sql(spark, "SELECT 1 AS a, 2 AS a").columns == ["a", "a"]
    assert run_sql(spark, "SELECT id FROM users WHERE id = 999").count() == 0
    assert run_sql(spark, "EXPLAIN DROP TABLE guarded").count() == 1
    assert spark.catalog.tableExists("guarded")


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ;; ",
        "DROP TABLE guarded",
        "INSERT INTO guarded VALUES (2)",
        "WITH x AS (SELECT 2 AS id) INSERT INTO guarded SELECT id FROM x",
        "FROM users INSERT INTO guarded SELECT id INSERT INTO guarded SELECT id",
        "CREATE TABLE t2 AS SELECT 1 AS a",
        "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "CACHE TABLE users",
        "TRUNCATE TABLE guarded",
        "ALTER TABLE guarded RENAME TO other",
        "SELECT 1; SELECT 2",
        "SELECT 1); DROP TABLE guarded; --",
        "SELECT 1) x; DROP TABLE guarded; SELECT * FROM (SELECT 1",
        "PRAGMA database_list",
        "SELEC 1",
    ],
)
def test_everything_else_is_refused(spark, users_view, text):
    with pytest.raises(NotReadOnly):
        run_sql(spark, text)
    assert [r[0] for r in spark.table("guarded").collect()] == [1]


def test_unknown_column_is_sparks_own_error(spark, users_view):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run_sql(spark, "SELECT nope FROM users")


def test_paging(spark):
    df = spark.range(60).select((59 - F.col("id")).alias("id"), F.lit("x").alias("name"))
    assert [r["id"] for r in paging.page(df, ["id"], 25, 50).collect()] == list(range(50, 60))
    many = spark.range(3000).toDF("id")
    with pytest.raises(ValueError, match="at most 1000"):
        paging.page(many, ["id"], limit=1001)
    assert paging.page(many, ["id"], limit=1500, max_size=2000).count() == 1500
    assert paging.page(df, ["id"]).count() == 25
    for limit, offset in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            paging.page(df, ["id"], limit, offset)
    rows, more = paging.page_with_next(df, ["id"], 2)
    assert ([r["id"] for r in rows.collect()], more) == (list(range(25, 50)), True)
    rows, more = paging.page_with_next(df, ["id"], 3)
    assert (rows.count(), more) == (10, False)
    rows, more = paging.page_with_next(df, ["id"], 99)
    assert ([r["id"] for r in rows.collect()], more) == (list(range(50, 60)), False)


def test_nulls_come_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "id int")
    assert [r["id"] for r in paging.page(df, ["id"]).collect()] == [1, 2, None]


def test_deep_page_equals_top_k_page(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.lit("x").alias("name")).repartition(7)
    monkeypatch.setattr(paging, "LEAF_ROWS", 100)
    for offset in (0, 2490, 4990, 6000):
        got = [r["id"] for r in paging.page(df, ["id"], 25, offset + 100).collect()]
        assert got == list(range(offset + 100, min(offset + 125, 5000)))


def test_deep_page_among_ties_and_nulls(spark, monkeypatch):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id") % 7))
    df = spark.range(2000).select(group.alias("g"), F.nullif(F.col("id") % 50, F.lit(7)).alias("h"), "id")
    keys = ["g", "h", "id"]
    wanted = [r["id"] for r in df.orderBy(*(F.col(k).asc_nulls_last() for k in keys)).collect()]
    monkeypatch.setattr(paging, "LEAF_ROWS", 40)
    for offset in (0, 655, 660, 1300, 1325, 1980, 1999, 2000):
        got = [r["id"] for r in paging.page(df, keys, 20, offset).collect()]
        assert got == wanted[offset : offset + 20]


def test_column_profile(spark, tables):
    rows = {(r["table_name"], r["column_name"]): r for r in catalog.column_profile(tables).collect()}
    assert len(rows) == 5
    name = rows["users", "name"]
    assert (name["ordinal"], name["n_rows"], name["n_null"]) == (2, 2, 0)
    assert (name["least_text"], name["greatest_text"], name["least_number"]) == ("Alice", "Bob", None)
    assert rows["users", "id"]["greatest_number"] == 2.0
    assert (rows["demographics", "age"]["n_rows"], rows["demographics", "age"]["n_null"]) == (0, 0)


def test_page_after(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "a int, b int")
    walked, last = [], None
    while True:
        page = paging.page_after(df, ["a", "b"], last, 7) if last else paging.page(df, ["a", "b"], 7)
        rows = [tuple(r) for r in page.collect()]
        if not rows:
            break
        walked += rows
        last = rows[-1]
    assert walked == [(i // 3, i) for i in range(30)]


def test_open_table(spark, users_view):
    assert paging.open_table(spark, "users").count() == 2
    with pytest.raises(paging.InvalidTableName):
        paging.open_table(spark, "users; DROP TABLE x")
    with pytest.raises(paging.TableNotFound):
        paging.open_table(spark, "nothing")


def test_row_records(spark):
    df = spark.createDataFrame(
        [(1, None, datetime.date(2020, 1, 2), 1.5)], "id int, name string, day date, `a.b` double"
    )
    record = json.loads(paging.row_records(df).first()[0])
    assert record == {"id": 1, "name": None, "day": "2020-01-02", "a.b": 1.5}
    doubled = spark.sql("SELECT 1 AS a, 'x' AS b, 2 AS a")
    assert json.loads(paging.row_records(doubled).first()[0]) == {"a": 2, "b": "x"}


def test_sql_refuses_java_calls_and_file_tables(spark, tmp_path):
    from pyspark.errors import AnalysisException

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    for call in ("java_method", "`reflect`", "Try_Reflect /* x */ "):
        with pytest.raises(NotReadOnly):
            run_sql(spark, f"SELECT {call}('java.lang.System', 'getProperty', 'x')")
    with pytest.raises(AnalysisException):
        run_sql(spark, f"SELECT * FROM parquet.`{path}`")
    assert run_sql(spark, "SELECT 'reflect(' AS x").first()["x"] == "reflect("
    assert spark.sql(f"SELECT * FROM parquet.`{path}`").count() == 3


def test_statements_side_by_side_leave_the_session_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    from trialspark.plans.sql import run_sql

    flag = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(flag, "true")
    spark.range(3).createOrReplaceTempView("side_by_side")
    with ThreadPoolExecutor(8) as pool:
        counts = list(pool.map(lambda _: run_sql(spark, "SELECT count(*) FROM side_by_side").first()[0], range(40)))
    assert counts == [3] * 40 and spark.conf.get(flag, "true") == before
    # A result joins with tables of the caller's session.
    assert run_sql(spark, "SELECT id FROM side_by_side").join(spark.range(2), "id").count() == 2
