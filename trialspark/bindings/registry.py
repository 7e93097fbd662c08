"""Registration of queries, and helpers shared by the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialspark.functions.numeric import round_scaled

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query, under its own name unless another is given."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Doubles rounded, as their last bits depend on the order of summation."""
    return df.withColumns({name: round_scaled(name, digits) for name in columns})


def sql_rounded(expression: str, digits: int) -> str:
    """SQL counterpart of ``rounded``."""
    scale = float(10**digits)
    return f"(round(({expression}) * {scale}) / {scale})"


def sql_text(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("'", "''") + "'"
