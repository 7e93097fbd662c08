"""A table that a stream fills batch by batch, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from trialspark.sources.discovery import literal_path

BATCH = "batch"


class BatchLog:
    """Rows of micro-batches in ``<root>/batches/batch=<id>``, the stream's checkpoint beside them.

    A batch counts once its ``_SUCCESS`` marker exists. A batch that is repeated after a
    failure is passed over if it counts already, and written anew if it does not. As the
    checkpoint lies in the same folder, batch numbers always mean the same rows.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.root}/batches/{BATCH}={batch}"

    def _hadoop(self, path: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def present(self, path: str) -> bool:
        system, file = self._hadoop(path)
        return system.exists(file)

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        top = f"{self.root}/batches"
        if not self.present(top):
            return []
        system, folder = self._hadoop(top)
        numbers = [int(status.getPath().getName().partition("=")[2]) for status in system.listStatus(folder)]
        return sorted(number for number in numbers if self.present(f"{self._path(number)}/_SUCCESS"))

    def write(self, rows: DataFrame, batch: int) -> None:
        if not self.present(f"{self._path(batch)}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(self._path(batch))

    def read(self, schema: StructType | None = None) -> DataFrame:
        """All rows that count, with their ``batch``; without any batch the schema has to be given."""
        paths = [literal_path(self._path(number)) for number in self.batches()]
        if not paths:
            if schema is None:
                raise FileNotFoundError(f"no batch has been stored in {self.root}")
            return self.spark.createDataFrame([], schema.add(BATCH, "int"))
        return self.spark.read.option("basePath", f"{self.root}/batches").parquet(*paths)

    def fill(self, stream: DataFrame, mode: str = "append") -> StreamingQuery:
        """Run a stream over all input there is, then stop; returns the ended query."""
        running = (
            stream.writeStream.outputMode(mode)
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .foreachBatch(self.write)
            .start()
        )
        running.awaitTermination()
        return running
