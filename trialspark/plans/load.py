"""Load a folder of delimited files into one table per file, with a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

from trialspark.operators.harmonize import DEFAULT_SYNONYMS, harmonize
from trialspark.plans.store import TableStore
from trialspark.sources.delimited import profile, scan, sniff
from trialspark.sources.discovery import discover_files, readable_paths

REPORT_SCHEMA = (
    "path string, table string, encoding string, sep string, status string, "
    "error string, n_rows long, n_ragged long"
)


def load_folder(
    spark: SparkSession,
    root: str,
    store: TableStore,
    synonyms: Mapping[str, Sequence[str]] = DEFAULT_SYNONYMS,
    concurrent_tables: int = 8,
) -> DataFrame:
    """Load every data file below ``root``; returns one report row per file.

    An existing table is left alone, so a repeated load only adds new files. Of
    several files with one table name the first that loads wins. A file that
    cannot be loaded is reported and the rest go on.

    Executors list the folder. The driver holds file names only; each file is sniffed, profiled and written
    by Spark jobs, and several files are in flight at a time.
    """
    plan = discover_files(spark, root).orderBy("table", "load_order").collect()
    single = [file["path"] for file in plan if file["first_part"] == file["path"]]
    copies = readable_paths(spark, single)
    by_table = [list(files) for _, files in groupby(plan, key=lambda file: file["table"])]

    def load_table(files: list[Row]) -> list[tuple]:
        return [_load_file(spark, file, copies, store, synonyms) for file in files]

    with ThreadPoolExecutor(max_workers=concurrent_tables) as pool:
        tasks = [pool.submit(inheritable_thread_target(spark)(load_table), fs) for fs in by_table]
        report = [row for task in tasks for row in task.result()]
    return spark.createDataFrame(report, REPORT_SCHEMA)


def _load_file(
    spark: SparkSession,
    file: Row,
    copies: Mapping[str, str],
    store: TableStore,
    synonyms: Mapping[str, Sequence[str]],
) -> tuple:
    path, table = file["path"], file["table"]
    layout = None
    try:
        readable = copies.get(path, path)
        layout = sniff(spark, readable, readable if path in copies else file["first_part"])
        if store.exists(table):
            return (path, table, layout.encoding, layout.sep, "skipped", None, None, None)
        found = profile(spark, layout)
        store.create(table, harmonize(scan(spark, found), synonyms))
        # Counting a stored parquet table reads file footers only.
        n_rows = store.read(table).count()
    except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
        encoding, sep = (layout.encoding, layout.sep) if layout else (None, None)
        return (path, table, encoding, sep, "failed", str(error).split("\n")[0], None, None)
    return (path, table, layout.encoding, layout.sep, "loaded", None, n_rows, found.n_ragged)
