"""Stable pages of a table, and rows as JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Page sizes of the table view.
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 1000
# A top-k never takes more rows than this from a task; deeper pages are narrowed down first.
LEAF_ROWS = 10_000


class InvalidTableName(ValueError):
    """The table name is no identifier."""


class TableNotFound(LookupError):
    """No such table."""


def open_table(spark: SparkSession, name: str) -> DataFrame:
    """Table by plain name, after checking that the name is an identifier and exists."""
    if not name.isidentifier():
        raise InvalidTableName(name)
    if not spark.catalog.tableExists(name):
        raise TableNotFound(name)
    return spark.table(name)


def _order(keys: Sequence[str]) -> list[Column]:
    return [F.col(key).asc_nulls_last() for key in keys]


def _check(limit: int, offset: int, max_size: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    if limit > max_size:
        raise ValueError(f"a page holds at most {max_size} rows")


def page(
    df: DataFrame,
    keys: Sequence[str],
    limit: int = DEFAULT_PAGE_SIZE,
    offset: int = 0,
    max_size: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """Rows ``offset .. offset+limit`` in key order; a limit above ``max_size`` is refused.

    The keys should order rows totally, or pages may overlap on ties. While the page
    lies deep, the rows are narrowed to the range of a key that holds its start: the table
    is never copied, and only one key column is shuffled.
    """
    _check(limit, offset, max_size)
    return _page(df, list(keys), list(keys), limit, offset)


def _page(df: DataFrame, keys: list[str], narrowing: list[str], limit: int, offset: int) -> DataFrame:
    if not narrowing or offset + limit <= LEAF_ROWS:
        return df.orderBy(*_order(keys)).offset(offset).limit(limit)
    key = F.col(narrowing[0])
    before, found, only = 0, None, True
    for row in _ranges(df, narrowing[0]):
        if before + row["n"] > offset:
            found = row
            break
        before, only = before + row["n"], False
    if found is None:
        return df.where(F.lit(False))
    low, high = F.lit(found["low"]), F.lit(found["high"])
    same = found["low"] == found["high"]
    if only and found["last"] and not same:
        # Too few values to draw ranges from.
        return _page(df, keys, [], limit, offset)
    holding = df.where(key.isNull() if found["missing"] else key.between(low, high))
    first = _page(holding, keys, narrowing[1:] if same else narrowing, limit, offset - before)
    short = limit - (found["n"] - (offset - before))
    if found["missing"] or short <= 0:
        return first
    following = df.where((key > high) | key.isNull()).orderBy(*_order(keys)).limit(short)
    return first.union(following).orderBy(*_order(keys))


def _ranges(df: DataFrame, key: str) -> list[Row]:
    """Ranges of a key in order: ``missing``, ``n``, ``low``, ``high``, and whether it is the ``last``.

    Counts and bounds are exact and come from one job, so it does not matter how the
    ranges were drawn. The driver sees one row per shuffle partition, one more for nulls.
    """
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        df.select(F.col(key).alias("k"))
        .repartitionByRange(n_ranges, F.col("k").asc_nulls_last())
        .select("k", F.spark_partition_id().alias("part"))
        .groupBy(F.col("k").isNull().alias("missing"), "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    )
    # Nulls share one range, whatever partitions they lie in.
    folded = counted.groupBy("missing", F.when(~F.col("missing"), F.col("part")).alias("part")).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    rows = folded.orderBy("missing", "part").collect()
    return [Row(**row.asDict(), last=row is rows[-1]) for row in rows]


def page_after(
    df: DataFrame,
    keys: Sequence[str],
    last: Sequence[object],
    limit: int = DEFAULT_PAGE_SIZE,
    max_size: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """Page that follows the row with key values ``last`` (keys must not be null).

    Walking page by page this way costs the same at any depth, and the first
    key's bound reaches the scan as a pushed filter.
    """
    _check(limit, 0, max_size)
    later = F.lit(False)
    tied = F.lit(True)
    for key, value in zip(keys, last):
        later = later | (tied & (F.col(key) > F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
    bounded = df.where(F.col(keys[0]) >= F.lit(last[0])).where(later)
    return bounded.orderBy(*_order(keys)).limit(limit)


def page_with_next(
    df: DataFrame,
    keys: Sequence[str],
    page_number: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    max_size: int = MAX_PAGE_SIZE,
) -> tuple[DataFrame, bool]:
    """A numbered page (from 1) and whether another follows.

    A page past the end steps back to the last page that has rows. One row more than the
    page holds is read, which tells both.
    """
    if size < 1:
        raise ValueError("a page holds at least one row")
    _check(size, 0, max_size)

    def read(number: int) -> list[Row]:
        return page(df, keys, size + 1, (number - 1) * size, max_size + 1).collect()

    number = max(page_number, 1)
    rows = read(number)
    if number > 1 and not rows:
        rows = read(max(1, -(-df.count() // size)))
    return df.sparkSession.createDataFrame(rows[:size], df.schema), len(rows) > size


def row_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as a JSON object, nulls kept, temporal values in ISO form.

    Of several columns with one name the last is kept.
    """
    positions = {column: at for at, column in enumerate(df.columns)}
    unique = df.toDF(*(f"c{at}" for at in range(len(df.columns))))
    fields = [F.col(f"c{at}").alias(column) for column, at in positions.items()]
    return unique.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))
