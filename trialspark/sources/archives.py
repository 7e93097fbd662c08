"""Unpack zip archives on the executors, one task per group of members."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.session import ensure_checkpoint_dir
from trialspark.sources.discovery import STAGING_PREFIX, list_files
from trialspark.sources.files import CHUNK, resolve

BAD_ZIP = "Bad Zip File"

_MEMBER_SCHEMA = "archive string, target string, member string, n_bytes long, error string"


def _safe_member(name: str) -> str | None:
    """Relative path of a member, never outside the target folder; None for a folder."""
    parts = [part for part in name.replace("\\", "/").split("/") if part not in ("", ".", "..")]
    return None if name.endswith("/") or not parts else "/".join(parts)


@contextmanager
def _opened(system: fs.FileSystem, path: str) -> Iterator[zipfile.ZipFile]:
    """An archive for reading; a small one in memory, as Arrow files refuse seeks before their start."""
    with system.open_input_file(path) as source:
        small = source.size() <= CHUNK
        with zipfile.ZipFile(io.BytesIO(source.read()) if small else source) as zipped:
            yield zipped


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Central directory of each archive; members are not read."""
    columns = ["archive", "target", "member", "n_bytes", "error"]
    for batch in batches:
        rows: list[tuple] = []
        for archive, target in zip(batch["archive"], batch["target"]):
            system, path = resolve(archive)
            try:
                with _opened(system, path) as zipped:
                    found = [
                        (archive, target, info.filename, info.file_size, None)
                        for info in zipped.infolist()
                        if _safe_member(info.filename)
                    ]
                # An archive without files still has a row, and becomes an empty folder.
                rows += found or [(archive, target, None, 0, None)]
            except (zipfile.BadZipFile, ArrowInvalid):
                rows.append((archive, target, None, None, BAD_ZIP))
        yield pd.DataFrame(rows, columns=columns)


def _staging(target: str) -> str:
    """Hidden sibling folder that an archive is unpacked into before it is complete."""
    parent, _, name = target.rpartition("/")
    return f"{parent}/{STAGING_PREFIX}{name}"


def _replace(system: fs.FileSystem, source: str, final: str) -> None:
    """Move onto ``final``, which an earlier attempt may have written already."""
    if system.get_file_info(final).type == fs.FileType.File:
        system.delete_file(final)
    system.move(source, final)


def _copy_member(zipped: zipfile.ZipFile, member: str, target: str) -> None:
    """Write one member through a temporary name, so a retried task leaves no half file."""
    system, root = resolve(_staging(target))
    final = posixpath.join(root, _safe_member(member))
    partial = f"{final}.{uuid.uuid4().hex}.partial"
    system.create_dir(posixpath.dirname(final), recursive=True)
    with zipped.open(member) as source, system.open_output_stream(partial) as sink:
        while chunk := source.read(CHUNK):
            sink.write(chunk)
    _replace(system, partial, final)


def _extract_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        errors: list[str | None] = list(batch["error"].where(batch["error"].notna(), None))
        for target in batch[batch["member"].isna() & batch["error"].isna()]["target"]:
            system, folder = resolve(_staging(target))
            system.create_dir(folder, recursive=True)
        todo = batch[batch["member"].notna()]
        for archive, members in todo.groupby("archive", sort=False):
            system, path = resolve(archive)
            with _opened(system, path) as zipped:
                for at, member, target in zip(members.index, members["member"], members["target"]):
                    try:
                        _copy_member(zipped, member, target)
                    except (zipfile.BadZipFile, zlib.error, EOFError):
                        errors[batch.index.get_loc(at)] = BAD_ZIP
                    except (RuntimeError, NotImplementedError) as error:
                        # Encrypted, or packed in a way Python cannot undo.
                        errors[batch.index.get_loc(at)] = str(error)
        yield batch.assign(error=errors)


def _deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give complete folders their final name, unless an earlier attempt has."""
    for batch in batches:
        for target in batch["target"]:
            (system, final), (_, staging) = resolve(target), resolve(_staging(target))
            if system.get_file_info(staging).type == fs.FileType.Directory:
                if system.get_file_info(final).type == fs.FileType.Directory:
                    # Without files, or its archive would have been skipped.
                    system.delete_dir(final)
                system.move(staging, final)
        yield batch


def expand_archives(spark: SparkSession, root: str) -> DataFrame:
    """Unpack every ``*.zip`` below ``root`` into a sibling folder of the same stem.

    Returns ``(archive, member, n_bytes, status, error)`` with status ``extracted``,
    ``skipped`` (the folder has files already), ``failed``, or ``held_back`` for a good
    member of an archive with a failed one. An archive without files has one row
    without a member.
    Listing an archive only costs its central directory; members are then spread
    over the cluster, so one huge archive is unpacked by many tasks, each copying
    in small chunks. A folder appears under its final name only when its archive
    is complete. The report is checkpointed, so the work is done once however
    often the result is used.
    """
    ensure_checkpoint_dir(spark)
    files = list_files(spark, root)
    archives = files.where(F.endswith("path", F.lit(".zip"))).select(
        F.col("path").alias("archive"),
        F.regexp_replace("path", r"\.zip$", "").alias("target"),
    )
    # Every folder level above a file, so that nested files count as well.
    levels = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(levels) - 1),
        lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/"),
    )
    present = files.select(F.explode(parents).alias("target")).distinct()
    todo = archives.join(present, "target", "left_anti").select("archive", "target")
    skipped = archives.join(present, "target", "left_semi").select(
        "archive",
        "target",
        F.lit(None).cast("string").alias("member"),
        F.lit(None).cast("long").alias("n_bytes"),
        F.lit(None).cast("string").alias("error"),
        F.lit("skipped").alias("status"),
    )
    # An explicit number: these rows are few bytes but much work, and adaptive
    # execution would merge them into one task by size.
    tasks = 2 * spark.sparkContext.defaultParallelism
    members = todo.repartition(tasks, "archive").mapInPandas(_list_members, _MEMBER_SCHEMA)
    spread = members.repartition(tasks, "archive", "member")
    outcome = F.when(F.col("error").isNull(), "extracted").otherwise("failed")
    extracted = spread.mapInPandas(_extract_members, _MEMBER_SCHEMA).withColumn("status", outcome)
    report = extracted.union(skipped.select(*extracted.columns)).checkpoint()

    failed = F.count_if(F.col("status") == "failed").alias("n_failed")
    worked = report.where("status != 'skipped'").groupBy("target").agg(failed)
    complete = worked.where("n_failed = 0").select("target").repartition(tasks, "target")
    complete.mapInPandas(_deliver, "target string").count()
    held_back = (F.col("status") == "extracted") & (F.col("n_failed") > 0)
    return report.join(worked, "target", "left").select(
        "archive", "member", "n_bytes", F.when(held_back, "held_back").otherwise(F.col("status")).alias("status"), "error"
    )
