"""Catalog listings and schema texts of a set of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from trialspark.types import display_name

Tables = Mapping[str, DataFrame]


def database_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Tables and views of a Spark database (temporary views included), by name."""
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    prefix = f"{quoted(database)}." if database else ""
    entries = sorted((table.name, table.isTemporary) for table in spark.catalog.listTables(database))
    return {
        name: spark.table(quoted(name) if temporary else prefix + quoted(name))
        for name, temporary in entries
    }


def list_tables(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(name)`` of every table, ascending."""
    rows = [(name,) for name in sorted(tables)]
    return spark.createDataFrame(rows, "name string").orderBy("name")


def describe_tables(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(table_name, ordinal, column_name, column_type)`` of every column."""
    rows = [
        (name, ordinal, field.name, display_name(field.dataType))
        for name in sorted(tables)
        for ordinal, field in enumerate(tables[name].schema.fields, start=1)
    ]
    schema = "table_name string, ordinal int, column_name string, column_type string"
    return spark.createDataFrame(rows, schema)


def schema_listing(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(name, columns)`` with ``columns`` an array of ``(name, type)`` in table order."""
    column = F.struct("ordinal", F.col("column_name").alias("name"), F.col("column_type").alias("type"))
    ordered = F.array_sort(F.collect_list(column))
    return (
        describe_tables(spark, tables)
        .groupBy(F.col("table_name").alias("name"))
        .agg(F.transform(ordered, lambda c: F.struct(c["name"], c["type"])).alias("columns"))
        .orderBy("name")
    )


def catalog_tables(spark: SparkSession, tables: Tables) -> DataFrame:
    """Queryable table metadata: ``(table_name, column_count, row_count)``.

    Row counts of parquet tables come from file footers; the per-table counts
    are one job.
    """
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("long").alias("column_count"), "row_count"
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.union, counted)


def _column_profile(name: str, df: DataFrame) -> DataFrame:
    plain = df.toDF(*(f"c{at}" for at in range(len(df.columns))))
    rows = []
    for at, field in enumerate(df.schema.fields):
        value = F.col(f"c{at}")
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(field.dataType, NumericType):
            number = value.cast("double")
        elif isinstance(field.dataType, (StringType, DateType, TimestampType, TimestampNTZType)):
            text = value.cast("string")
        rows.append(
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(at + 1).alias("ordinal"),
                F.lit(field.name).alias("column_name"),
                F.lit(display_name(field.dataType)).alias("column_type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(value.isNull()).alias("n_null"),
                F.min(number).alias("least_number"),
                F.max(number).alias("greatest_number"),
                F.min(text).alias("least_text"),
                F.max(text).alias("greatest_text"),
            )
        )
    return plain.agg(F.array(*rows).alias("columns")).select(F.inline("columns"))


def column_profile(tables: Tables) -> DataFrame:
    """Every column of every table: type, rows, nulls, least and greatest value.

    One aggregate per table. Numbers are compared as doubles, texts, dates and times as
    text; columns of other types have neither bound. Empty tables have zero counts.
    """
    return reduce(DataFrame.union, (_column_profile(name, df) for name, df in sorted(tables.items())))


def schema_bullets(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(table_name, text)``: a heading, then one ``- column (TYPE)`` line per column."""
    line = F.concat(F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("column_type"), F.lit(")\n"))
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda item: item["line"]), "")
    heading = F.concat(F.lit("Table: "), F.col("table_name"), F.lit("\nColumns:\n"))
    return (
        describe_tables(spark, tables)
        .groupBy("table_name")
        .agg(body.alias("body"))
        .select("table_name", F.concat(heading, "body").alias("text"))
    )


def sample_line(df: DataFrame, order_by: Sequence[str] | None = None) -> str:
    """One row of a table as text; the least one by ``order_by`` if that is given."""
    try:
        row = (df.orderBy(*order_by) if order_by else df).first()
    except Exception:  # noqa: BLE001 - an unreadable table must not hide the others
        return "Sample row: (could not fetch)"
    return f"Sample row: {tuple(row)!r}" if row else "Sample row: (empty table)"


def schema_text(
    spark: SparkSession, tables: Tables, order_by: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """``(table_name, text)``: name, columns and a sample row of each table.

    Without an order key for a table its sample is whatever row a one-row read
    finds first, which costs next to nothing on a table of any size.
    """
    keys = order_by or {}
    rows = []
    for name in sorted(tables):
        df = tables[name]
        columns = ", ".join(f"{f.name} ({display_name(f.dataType)})" for f in df.schema.fields)
        sample = sample_line(df, keys.get(name))
        rows.append((name, f"Table: {name}\nColumns: {columns}\n{sample}"))
    return spark.createDataFrame(rows, "table_name string, text string")


def joined_schema_text(texts: DataFrame) -> DataFrame:
    """All table texts as one ``(schema_text)`` row, blank line between tables."""
    parts = F.array_sort(F.collect_list(F.struct("table_name", "text")))
    text = F.array_join(F.transform(parts, lambda part: part["text"]), "\n\n")
    return texts.agg(text.alias("schema_text"))
