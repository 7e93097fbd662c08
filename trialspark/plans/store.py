"""Where loaded tables live: a Spark database, or a folder of parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.sources.discovery import literal_path


class TableStore(Protocol):
    """Tables by name. ``create`` never touches an existing table."""

    def exists(self, name: str) -> bool: ...

    def names(self) -> list[str]: ...

    def read(self, name: str) -> DataFrame: ...

    def create(self, name: str, df: DataFrame) -> None: ...

    def append(self, name: str, df: DataFrame) -> None: ...

    def append_all(self, rows: Mapping[str, DataFrame]) -> None: ...


class CatalogStore:
    """Managed tables of a Spark database."""

    def __init__(self, spark: SparkSession, database: str = "default") -> None:
        self.spark = spark
        self.database = database

    def _quoted(self, name: str) -> str:
        escaped = name.replace("`", "``")
        return f"`{self.database}`.`{escaped}`"

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._quoted(name))

    def names(self) -> list[str]:
        tables = self.spark.catalog.listTables(self.database)
        return sorted(table.name for table in tables if not table.isTemporary)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._quoted(name))

    def create(self, name: str, df: DataFrame) -> None:
        df.write.mode("ignore").saveAsTable(self._quoted(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").saveAsTable(self._quoted(name))

    def append_all(self, rows: Mapping[str, DataFrame]) -> None:
        """Append to several tables, one after the other: managed tables have no common commit."""
        for name, df in rows.items():
            self.append(name, df)


class FolderStore:
    """Parquet tables below one folder, ``<root>/<table>``.

    A table is complete with its ``_SUCCESS`` marker; without it ``create`` writes it anew.
    Rows that are added to several tables at once lie in ``<root>/_batches/<batch>/<table>``
    and count once the file ``<root>/_commits/<batch>`` exists.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, path: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def _present(self, path: str) -> bool:
        system, file = self._hadoop(path)
        return system.exists(file)

    def _batches(self) -> list[str]:
        """Folders of the committed batches, one for each ``append_all``."""
        commits = f"{self.root}/_commits"
        if not self._present(commits):
            return []
        system, folder = self._hadoop(commits)
        return sorted(f"{self.root}/_batches/{status.getPath().getName()}" for status in system.listStatus(folder))

    def _stored_plainly(self, name: str) -> bool:
        # The marker comes last, when a write commits: what an interrupted write left is no table.
        return self._present(f"{self._path(name)}/_SUCCESS")

    def exists(self, name: str) -> bool:
        return self._stored_plainly(name) or any(self._present(f"{batch}/{name}") for batch in self._batches())

    def names(self) -> list[str]:
        files = (
            self.spark.read.format("binaryFile")
            .options(pathGlobFilter="*.parquet", recursiveFileLookup="true")
            .load(literal_path(self.root))
        )
        folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
        found = {row[0] for row in files.select(folder).distinct().collect()}
        for batch in self._batches():
            system, path = self._hadoop(batch)
            found |= {status.getPath().getName() for status in system.listStatus(path)}
        return sorted(found)

    def read(self, name: str) -> DataFrame:
        paths = [f"{batch}/{name}" for batch in self._batches() if self._present(f"{batch}/{name}")]
        if not paths or self._present(self._path(name)):
            paths.append(self._path(name))
        return self.spark.read.parquet(*map(literal_path, paths))

    def create(self, name: str, df: DataFrame) -> None:
        if not self.exists(name):
            df.write.mode("overwrite").parquet(self._path(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path(name))

    def append_all(self, rows: Mapping[str, DataFrame]) -> None:
        """Append to several tables at once: readers see all of the new rows or none.

        What a failed call has written is never read.
        """
        batch = uuid.uuid4().hex
        for name, df in rows.items():
            df.write.parquet(f"{self.root}/_batches/{batch}/{name}")
        # One file makes all tables' rows count.
        system, commit = self._hadoop(f"{self.root}/_commits/{batch}")
        system.create(commit, False).close()
