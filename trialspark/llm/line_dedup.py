"""Lines that many documents share, found with levelled sorted runs, in DataFrame functions only.

A line's key is the line without blanks at both ends, A-Z lower-cased, and stands as 128
bits of hash. Documents come in batches. A run is a table ``(h1, h2, n)``: keys with the
number of documents that have them, bucketed by key and sorted inside each bucket. A new
batch is merge-anti-joined with the keys that a run already knows to be in enough
documents, and what is left becomes a run of its own. Two runs of one level are compacted
by a merge join into one run of the next level, so a key is rewritten a logarithmic number
of times. Batches, runs and merges share one bucketing: none of these joins shuffles.

Documents are then tested line by line: keys with a ten-thousandth of all occurrences or
more, at most 10,000 of them, are broadcast, so that no hot line meets in one task; the
others are joined by key, each with few occurrences.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.stored import stored
from trialspark.session import new_workspace

MIN_DOCUMENTS = 10
MIN_CHARS = 1
BATCHES = 4
# Keys that hold at least one in so many occurrences are broadcast, so there are no more than these.
HEAVY_KEYS = 10_000
KEY = ["h1", "h2"]

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty ones have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at both ends, with A-Z (and no other letters) lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def batch_counts(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """``(batch, h1, h2, n)``: documents of each batch that have a key. Each row is a document."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), key_of))
    batch = F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int")
    rows = docs.select(batch.alias("batch"), F.explode(keys).alias("key"))
    hashed = rows.where(F.length("key") >= min_chars).select("batch", *_hashes(F.col("key")))
    return hashed.groupBy("batch", *KEY).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Levels of sorted, bucketed runs of line keys; level ``i`` holds one run of up to ``2**i`` batches."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCUMENTS) -> None:
        self.spark = spark
        self.min_docs = min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self._folder = new_workspace(spark, "line-runs")
        self._tables: list[str] = []

    def write(self, keys: DataFrame, *partitions: str) -> DataFrame:
        """Keep keys as a bucketed table in the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self._folder}/{name}")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.saveAsTable(name)
        self._tables.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """Add the keys of a batch of new documents, as ``(h1, h2, n)``."""
        for run in filter(None, self.levels):
            batch = batch.join(run.where(F.col("n") >= self.min_docs).hint("merge"), KEY, "left_anti")
        run, level = self.write(batch), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run = self.write(_merged(self.levels[level], run))
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def frequent(self) -> DataFrame:
        """``(h1, h2, n)`` of the keys in at least ``min_docs`` documents, kept in the shared folder.

        A key that was settled is no longer counted, so ``n`` is a lower bound above that.
        """
        runs = list(filter(None, self.levels))
        every = reduce(_merged, runs) if runs else self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return stored(every.where(F.col("n") >= self.min_docs), "frequent-lines")

    def forget(self) -> None:
        """Take the runs out of the session's catalog; their files stay in the shared folder."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("n", "m").hint("merge"), KEY, "full")
    return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """``(h1, h2, n)`` of the line keys that at least ``min_docs`` documents have."""
    runs = LineRuns(docs.sparkSession, min_docs)
    counts = batch_counts(docs, batches, min_chars).repartition(runs.buckets, *KEY)
    arrived = runs.write(counts, "batch")
    for batch in range(batches):
        runs.add(arrived.where(F.col("batch") == batch).drop("batch"))
    found = runs.frequent()
    runs.forget()
    return found


def without_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """``docs(doc_id, text, ..)`` with ``n_lines, n_dropped, kept``: lines of frequent keys are gone.

    Lines are separated by a line feed. A key of at least ``min_chars`` code points that at
    least ``min_docs`` rows have loses all its lines, repeats inside one text included. Each
    row is a document of its own: repeated rows, repeated and null ids count row by row. A
    null or empty text is one empty line. Other columns stay; those named like a new one
    are replaced.
    """
    new = ["n_lines", "n_dropped", "kept"]
    rest = docs.drop(*new)
    names = [f"c{i}" for i in range(len(rest.columns))]
    plain = rest.toDF(*names)
    id_column, text = names[rest.columns.index("doc_id")], F.col(names[rest.columns.index("text")])
    found = frequent_lines(plain.select(text.alias("text")), min_docs, min_chars, batches)

    # Rows with the same id and text have the same lines, so they may share their hits.
    row = [F.col(id_column).alias("row_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]
    hits = _hits(plain.select(*row, F.posexplode(lines_of(text)).alias("at", "line")), found)
    own = plain.select("*", *row[1:])
    same = (F.col("t1") == hits["h_t1"]) & (F.col("t2") == hits["h_t2"]) & F.col(id_column).eqNullSafe(hits["h_id"])
    joined = own.join(hits, same, "left")

    # Positions of dropped lines, with one before the first line and one behind the last.
    gone = F.coalesce("places", F.array().cast("array<int>"))
    staged = joined.select(*names, lines_of(text).alias("lines"), gone.alias("gone")).withColumn(
        "bounds", F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    )
    between = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.slice("lines", F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1),
    )
    kept = F.flatten(between)
    return staged.select(
        *names,
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    ).toDF(*rest.columns, *new)


def _hits(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(h_id, h_t1, h_t2, places)``: sorted positions of frequent lines, for rows that have any."""
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_heavy = F.col("n") * HEAVY_KEYS >= total
    heavy = found.where(is_heavy).select(*KEY, F.lit(True).alias("heavy"))
    light = found.where(~is_heavy).select(*KEY, F.lit(True).alias("light"))
    keyed = lines.select("row_id", "t1", "t2", "at", *_hashes(key_of(F.col("line"))))
    first = keyed.join(F.broadcast(heavy), KEY, "left")
    # A decided line needs no partner: it is dealt out by its place instead of its hot key.
    apart = F.when(F.col("heavy"), F.xxhash64("t1", "at")).otherwise(F.col("h1"))
    both = first.withColumn("h1", apart).join(light, KEY, "left").where("heavy OR light")
    return both.groupBy(
        F.col("row_id").alias("h_id"), F.col("t1").alias("h_t1"), F.col("t2").alias("h_t2")
    ).agg(F.array_sort(F.collect_set("at")).alias("places"))
