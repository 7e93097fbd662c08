"""Find the delimited files below a folder and plan their table names."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.text import file_stem, table_name
from trialspark.session import new_workspace
from trialspark.sources.files import copy_files, files_below, qualified

# Files that are never data, and folders of archives not yet unpacked.
HIDDEN_PREFIX = "._"
STAGING_PREFIX = ".extracting-"
DOCUMENT_WORDS = ("Glossary", "Protocol")


def literal_path(path: str) -> str:
    """Escape glob characters, so that a path names exactly one file."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, root: str, *endings: str) -> DataFrame:
    """``(path, length)`` of the files below a folder, listed by the executors.

    Names that start with ``_`` or a dot count, which Spark's sources pass over; what an
    archive is being unpacked into does not.
    """
    files = files_below(spark, root)
    above = len(qualified(spark, root).rstrip("/")) + 1
    staged = F.contains(F.concat(F.lit("/"), F.substring("path", above + 1, 1 << 30)), F.lit(f"/{STAGING_PREFIX}"))
    wanted = reduce(Column.__or__, (F.endswith("path", F.lit(ending)) for ending in endings), F.lit(not endings))
    return files.where(wanted & ~staged)


def readable_paths(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """For each single file with a hidden name a copy that Spark's sources read, made by the executors."""
    hidden = [path for path in paths if path.rsplit("/", 1)[-1].startswith(("_", "."))]
    folder = new_workspace(spark, "hidden") if hidden else ""
    copies = {path: f"{folder}/{i}/file{path.rsplit('/', 1)[-1]}" for i, path in enumerate(hidden)}
    copy_files(spark, copies)
    return copies


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per data file: ``path, name, table, load_order, n_parts, n_bytes, first_part``.

    A folder ``x.csv/`` or ``x.txt/`` of ``part-*`` files, as Spark writes them,
    counts as the single file ``x.csv`` / ``x.txt``. All ``.csv`` files come
    before all ``.txt`` files, by path within each kind.
    """
    files = list_files(spark, root, ".csv", ".txt")
    parent = F.regexp_extract("path", r"(?s)^(.*\.(?:csv|txt))/part-[^/]*$", 1)
    logical = files.withColumn("file", F.when(parent != "", parent).otherwise(F.col("path")))
    name = F.substring_index("file", "/", -1)
    part_name = F.substring_index("path", "/", -1)
    wanted = ~part_name.startswith(HIDDEN_PREFIX) & ~name.startswith(HIDDEN_PREFIX)
    for word in DOCUMENT_WORDS:
        wanted = wanted & ~name.contains(word)
    return (
        logical.where(wanted)
        .groupBy(F.col("file").alias("path"))
        .agg(
            F.count(F.lit(1)).alias("n_parts"),
            F.sum("length").alias("n_bytes"),
            F.min(F.struct((F.col("length") == 0).alias("empty"), "path")).alias("first"),
        )
        .withColumn("name", F.substring_index("path", "/", -1))
        .select(
            "path",
            "name",
            table_name(file_stem("name")).alias("table"),
            F.struct(F.col("name").endswith(".txt").alias("is_txt"), "path").alias("load_order"),
            "n_parts",
            "n_bytes",
            F.col("first.path").alias("first_part"),
        )
    )
