"""Intermediate tables in the shared folder, which also cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialspark.session import new_workspace


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: executors can be lost after that."""
    spark = df.sparkSession
    path = f"{new_workspace(spark, purpose)}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int) -> int:
    """Partitions so that each holds about ``per_partition`` bytes; two per core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // per_partition))
