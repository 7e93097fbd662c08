"""Files as the executors see them: listing, copying and byte ranges through Arrow file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from trialspark.session import ensure_checkpoint_dir

CHUNK = 1 << 20
# A task that lists a folder goes down into its folders until it has seen this many entries;
# the folders left over are dealt to other tasks.
ENTRIES_PER_TASK = 10_000
LISTING = "path string, length long, is_folder boolean"

# Names of schemes that Arrow spells differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a URI as Spark prints it (``file:/x``, ``hdfs://..``)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    parts = re.match(r"(?s)(\w[\w+.-]*)://([^/]*)(.*)$", uri)
    if parts is None:
        return fs.LocalFileSystem(), uri
    scheme, authority, path = parts.groups()
    # The path itself is not parsed as a URI: it may hold blanks, percent and question marks.
    system, top = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{authority}/")
    return system, top.rstrip("/") + path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Hadoop completes it; fails if nothing is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(folder).getPath().toString()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            system, top = resolve(uri)
            prefix = uri[: len(uri) - len(top)] if uri.endswith(top) else ""
            folders, seen = [top], 0
            while folders and seen < ENTRIES_PER_TASK:
                entries = system.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True))
                seen += len(entries)
                files = [entry for entry in entries if entry.type == fs.FileType.File]
                folders += [entry.path for entry in entries if entry.type == fs.FileType.Directory]
                yield _listed([(prefix + entry.path, entry.size, False) for entry in files])
            yield _listed([(prefix + folder, None, True) for folder in folders])


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_())
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["path", "length", "is_folder"])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files below a folder, whatever their names; content is never read.

    Executors list it: each round a job expands a frontier of folders, every task going
    down a bounded way, and the driver learns only how many folders are left. Each round
    is checkpointed, so every user of the listing sees the same files.
    """
    ensure_checkpoint_dir(spark)
    spread = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(qualified(spark, root),)], "path string").coalesce(1)
    found = None
    while True:
        level = frontier.mapInArrow(_expand, LISTING).checkpoint()
        files = level.where("NOT is_folder").select("path", "length")
        found = files if found is None else found.union(files)
        frontier = level.where("is_folder").select("path")
        if not frontier.count():
            return found
        frontier = frontier.repartition(spread)


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
            (system, path), (store, final) = resolve(source), resolve(target)
            folder, _, name = final.rpartition("/")
            # Not hidden while half written would be a file to Spark's readers.
            partial = f"{folder}/.{name}.{uuid.uuid4().hex}"
            store.create_dir(folder, recursive=True)
            with system.open_input_stream(path) as taken, store.open_output_stream(partial) as given:
                while piece := taken.read(CHUNK):
                    given.write(piece)
            if store.get_file_info(final).type == fs.FileType.File:
                store.delete_file(final)
            store.move(partial, final)
        yield batch


def copy_files(spark: SparkSession, targets: dict[str, str]) -> None:
    """Copy files on the executors, in small pieces, one task per file."""
    if targets:
        pairs = spark.createDataFrame(list(targets.items()), "source string, target string")
        pairs.repartition(len(targets), "source").mapInArrow(_copy, pairs.schema).write.format("noop").mode("overwrite").save()
