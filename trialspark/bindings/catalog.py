"""Catalog, paging and SQL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import TABLES, all_tables, query, table
from trialspark.functions.text import route_input
from trialspark.operators.paging import page, page_after, page_with_next, row_records
from trialspark.plans import catalog as plans
from trialspark.plans.sql import run_sql

SQL_TABLE_NAMES = ", ".join(f"'{name}'" for name in TABLES)
SQL_COLUMNS = f"""(SELECT table_name, ordinal_position AS ordinal, column_name, data_type AS column_type
    FROM information_schema.columns WHERE table_name IN ({SQL_TABLE_NAMES}))"""


# Types whose least and greatest values are numbers or texts.
SQL_NUMBERS = "('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE')"
SQL_TEXTS = "('VARCHAR', 'DATE', 'TIMESTAMP', 'TIMESTAMP WITH TIME ZONE')"


def _sql_profile(name: str) -> str:
    number = f"CASE WHEN c.column_type IN {SQL_NUMBERS} THEN TRY_CAST(v AS DOUBLE) END"
    text = f"CASE WHEN c.column_type IN {SQL_TEXTS} THEN v END"
    return f"""SELECT c.table_name, c.ordinal, c.column_name, c.column_type,
        (SELECT count(*) FROM {name}) AS n_rows, (SELECT count(*) FROM {name}) - count(v) AS n_null,
        min({number}) AS least_number, max({number}) AS greatest_number,
        min({text}) AS least_text, max({text}) AS greatest_text
        FROM {SQL_COLUMNS} c LEFT JOIN
        (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {name}) ON COLUMNS(*) INTO NAME k VALUE v) u
        ON u.k = c.column_name WHERE c.table_name = '{name}' GROUP BY ALL"""


@query(" UNION ALL ".join(map(_sql_profile, TABLES)))
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Tables, columns and types, with what the rows hold."""
    return plans.column_profile(all_tables(spark, folder))


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {SQL_COLUMNS} WHERE table_name = '{name}')"
        f" AS column_count, (SELECT count(*) FROM {name}) AS row_count"
        for name in TABLES
    )
    + ") WHERE column_count >= 4"
)
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    return plans.catalog_tables(spark, all_tables(spark, folder)).where("column_count >= 4")


SQL_BULLETS = f"""(SELECT table_name, 'Table: ' || table_name || chr(10) || 'Columns:' || chr(10) ||
    string_agg('- ' || column_name || ' (' || column_type || ')' || chr(10), '' ORDER BY ordinal) AS text
    FROM {SQL_COLUMNS} GROUP BY table_name)"""


LINEITEM_KEYS = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)

# Keys that make the sample row of a table the same in every run.
SAMPLE_KEYS = {
    "customer": ["c_custkey"],
    "events": ["event_id"],
    "labels": ["doc_id"],
    "lineitem": list(LINEITEM_KEYS),
    "nation": ["n_nationkey"],
    "orders": ["o_orderkey"],
    "part": ["p_partkey"],
    "region": ["r_regionkey"],
    "supplier": ["s_suppkey"],
}


def _sql_sample(name: str, key: str, *values: str) -> str:
    shown = " || ', ' || ".join(values)
    columns = f"(SELECT string_agg(column_name || ' (' || column_type || ')', ', ' ORDER BY ordinal) FROM {SQL_COLUMNS} WHERE table_name = '{name}')"
    return f"""SELECT '{name}' AS table_name, 'Table: {name}' || chr(10) || 'Columns: ' || {columns} ||
        chr(10) || 'Sample row: (' || {shown} || ')' AS text
        FROM (SELECT * FROM {name} ORDER BY {key} LIMIT 1)"""


def _quoted(column: str) -> str:
    return f"chr(39) || {column} || chr(39)"


def _or_none(column: str) -> str:
    return f"coalesce({column}::VARCHAR, 'None')"


def _moment(column: str) -> str:
    """A time as Python shows it: seconds and microseconds only where there are any."""
    micros = f"(epoch_us({column}) % 60000000)"
    return f"""strftime({column}, 'datetime.datetime(%Y, %-m, %-d, %-H, %-M') ||
        CASE WHEN {micros} > 0 THEN ', ' || ({micros} // 1000000) ELSE '' END ||
        CASE WHEN {micros} % 1000000 > 0 THEN ', ' || ({micros} % 1000000) ELSE '' END || ')'"""


SQL_SCHEMA_TEXT = "(" + " UNION ALL ".join(
    [
        _sql_sample(
            "customer", "c_custkey", "c_custkey", _quoted("c_name"), "c_nationkey", "c_acctbal",
            _quoted("c_mktsegment"),
        ),
        _sql_sample(
            "events", "event_id", "event_id", _moment("ts"), "user_id", _quoted("event_type"), "value",
            _quoted("props"),
        ),
        _sql_sample("labels", "doc_id", "doc_id", _or_none("quality"), _or_none("toxic")),
        _sql_sample(
            "lineitem", ", ".join(LINEITEM_KEYS), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", _quoted("l_returnflag"),
            _quoted("l_linestatus"), _moment("l_shipdate"),
        ),
        _sql_sample("region", "r_regionkey", "r_regionkey", _quoted("r_name")),
        _sql_sample("nation", "n_nationkey", "n_nationkey", _quoted("n_name"), "n_regionkey"),
        _sql_sample(
            "orders", "o_orderkey", "o_orderkey", "o_custkey", _quoted("o_orderstatus"), "o_totalprice",
            "strftime(o_orderdate, 'datetime.datetime(%Y, %-m, %-d, %-H, %-M)')",
            _quoted("o_orderpriority"),
        ),
        _sql_sample(
            "part", "p_partkey", "p_partkey", _quoted("p_name"), _quoted("p_brand"), _quoted("p_type"),
            "p_size", "p_retailprice",
        ),
        _sql_sample("supplier", "s_suppkey", "s_suppkey", _quoted("s_name"), "s_nationkey", "s_acctbal"),
    ]
) + ")"


def sampled_schema(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in SAMPLE_KEYS}
    return plans.schema_text(spark, tables, SAMPLE_KEYS)


@query(f"SELECT table_name, text FROM {SQL_SCHEMA_TEXT}")
def schema_text(spark: SparkSession, folder: str) -> DataFrame:
    return sampled_schema(spark, folder)


@query(f"SELECT * FROM lineitem ORDER BY {', '.join(LINEITEM_KEYS)} LIMIT 25 OFFSET 50")
def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    return page(table(spark, folder, "lineitem"), LINEITEM_KEYS, limit=25, offset=50)


LINEITEM_ORDER = ", ".join(LINEITEM_KEYS)


@query(
    f"""SELECT * FROM lineitem ORDER BY {LINEITEM_ORDER}
    LIMIT 25 OFFSET (SELECT count(*) // 2 + 7 FROM lineitem)"""
)
def page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page past the middle of the table."""
    lines = table(spark, folder, "lineitem")
    return page(lines, LINEITEM_KEYS, limit=25, offset=lines.count() // 2 + 7)


@query(
    f"""(SELECT *, 3 AS page_number, (SELECT count(*) FROM lineitem) > 75 AS has_next FROM lineitem
        ORDER BY {LINEITEM_ORDER} LIMIT 25 OFFSET 50)
    UNION ALL (SELECT *, -1, false FROM lineitem
        ORDER BY {LINEITEM_ORDER} LIMIT 25 OFFSET (SELECT (count(*) - 1) // 25 * 25 FROM lineitem))"""
)
def page_next(spark: SparkSession, folder: str) -> DataFrame:
    """The third page, and the last one by asking for one far past the end."""
    lines = table(spark, folder, "lineitem")
    third, more = page_with_next(lines, LINEITEM_KEYS, 3)
    last, none = page_with_next(lines, LINEITEM_KEYS, 10**9)
    return third.select("*", F.lit(3).alias("page_number"), F.lit(more).alias("has_next")).union(
        last.select("*", F.lit(-1), F.lit(none))
    )


@query(
    f"""SELECT * FROM lineitem WHERE row({LINEITEM_ORDER}) > (
        SELECT row({LINEITEM_ORDER}) FROM lineitem ORDER BY {LINEITEM_ORDER} LIMIT 1 OFFSET 49)
    ORDER BY {LINEITEM_ORDER} LIMIT 25"""
)
def page_key(spark: SparkSession, folder: str) -> DataFrame:
    """The page that follows the 50th row."""
    lines = table(spark, folder, "lineitem")
    last = page(lines, LINEITEM_KEYS, limit=1, offset=49).first()
    return page_after(lines, LINEITEM_KEYS, [last[key] for key in LINEITEM_KEYS], limit=25)


ADHOC = """-- orders by status
WITH busy AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)
SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS greatest
FROM orders JOIN busy USING (o_custkey)
GROUP BY o_orderstatus;
"""


@query(ADHOC.strip().rstrip(";"))
def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return run_sql(spark, ADHOC)


@query(
    """SELECT to_json({'c_custkey': c_custkey, 'name': c_name, 'segment': nullif(c_mktsegment, 'BUILDING'),
    'balance': c_acctbal})::VARCHAR AS record FROM customer""",
    name="row_records",
)
def row_records_json(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        # Two columns of one name: the record keeps the last.
        F.lit("dropped").alias("segment"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    return row_records(customers)


# How console inputs may start, and the class each form belongs to.
INPUT_FORMS = (
    ("plain", "Say: ", "natural_language"),
    ("select", "  SELECT ", "sql"),
    ("with", "without ", "sql"),
    ("show", "\n\tShow ", "sql"),
    ("describe", "DESCRIBE ", "sql"),
    ("pragma", "pragma_", "sql"),
    ("comment", "-- select\nselect ", "natural_language"),
)


@query(
    "SELECT conv_id, turn, form, class FROM conversations, (VALUES "
    + ", ".join(f"('{form}', '{cls}')" for form, _, cls in INPUT_FORMS)
    + ") AS v(form, class) UNION ALL SELECT conv_id, turn, 'word', CASE role WHEN 'user' THEN 'exit' "
    "WHEN 'system' THEN 'ignore' ELSE 'natural_language' END FROM conversations"
)
def route_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn in every input form, and a one-word input per turn."""
    forms = [
        F.struct(F.lit(form).alias("form"), F.concat(F.lit(start), "text").alias("input"))
        for form, start, _ in INPUT_FORMS
    ]
    word = F.when(F.col("role") == "user", " Quit\n").when(F.col("role") == "system", " \t ")
    forms.append(F.struct(F.lit("word").alias("form"), word.otherwise("quitting").alias("input")))
    inputs = table(spark, folder, "conversations").select("conv_id", "turn", F.inline(F.array(*forms)))
    return inputs.select("conv_id", "turn", "form", route_input("input").alias("class"))
