"""Incremental load: delimited files that keep coming into one folder, all of one layout."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators.harmonize import unique_headers
from trialspark.sources.delimited import MALFORMED, TEXT, Profile, fits, profile, sniff, typed
from trialspark.sources.discovery import discover_files, literal_path
from trialspark.streaming.batch_log import BatchLog

SOURCE, MISFITS = "_source", "_misfits"


@dataclass(frozen=True)
class FileForm:
    """How the files of one folder are written, and what their columns hold."""

    encoding: str
    sep: str
    quote: str
    escape: str
    line_sep: str | None
    header: bool
    multi_line: bool
    names: list[str]
    kinds: list[str]

    @classmethod
    def of(cls, found: Profile) -> FileForm:
        layout = found.layout
        names = unique_headers(layout.first_row) if found.header else [f"column{i}" for i in range(layout.width)]
        return cls(
            layout.encoding,
            layout.sep,
            layout.quote,
            layout.escape,
            layout.line_sep,
            found.header,
            found.multi_line,
            list(names),
            list(found.kinds),
        )

    def options(self) -> dict[str, str]:
        found = {
            "sep": self.sep,
            "quote": self.quote,
            "escape": self.escape,
            "header": str(self.header),
            "enforceSchema": "true",
            "multiLine": str(self.multi_line),
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": MALFORMED,
        }
        if self.encoding == "utf-16":
            found["encoding"] = "UTF-16" if self.multi_line else "UTF-16LE"
            if not self.multi_line:
                found["lineSep"] = self.line_sep or "\n"
        return found


_FORM_SCHEMA = (
    "encoding string, sep string, quote string, escape string, line_sep string, header boolean, "
    "multi_line boolean, names array<string>, kinds array<string>"
)


def load_new_files(spark: SparkSession, folder: str, root: str) -> DataFrame | None:
    """Append the files of ``folder`` that no earlier run has loaded to the table in ``root``.

    Returns the table so far, or None as long as there is no file with a column. The first
    run settles layout, column names and kinds by the first file, and they stay. Beside
    its columns the table has ``_source`` (the file), ``_misfits`` (name and text of each
    value that doesn't fit its column's kind and so is null in it), ``_malformed`` (the text
    of a record with another number of fields) and ``batch``: later files lose nothing.

    It is a file stream that ends when it has seen all files; a run that failed half way
    goes on with the batch that did not count, so no file is loaded twice. As everywhere in
    Spark's file streams, a file is known by its path: files are added whole, by renaming,
    and not changed afterwards; names that start with ``_`` or a dot are left out.
    """
    log = BatchLog(spark, root)
    form = _settled_form(spark, folder, log)
    if form is None:
        return None
    log.fill(_stream(spark, folder, form))
    return log.read(_stream(spark, folder, form).schema)


def _settled_form(spark: SparkSession, folder: str, log: BatchLog) -> FileForm | None:
    path = f"{log.root}/form"
    if log.present(f"{path}/_SUCCESS"):
        return FileForm(**spark.read.schema(_FORM_SCHEMA).parquet(literal_path(path)).first().asDict())
    hidden = F.col("name").startswith("_") | F.col("name").startswith(".")
    first = discover_files(spark, folder).where(~hidden & (F.col("n_bytes") > 0)).orderBy("load_order").first()
    if first is None:
        return None
    found = profile(spark, sniff(spark, first["path"], first["first_part"]))
    if not found.layout.width:
        return None
    form = FileForm.of(found)
    spark.createDataFrame([tuple(asdict(form).values())], _FORM_SCHEMA).write.mode("overwrite").parquet(path)
    return form


def _stream(spark: SparkSession, folder: str, form: FileForm) -> DataFrame:
    fields = [f"c{i}" for i in range(len(form.names))]
    schema = ", ".join(f"{field} string" for field in [*fields, MALFORMED])
    lines = (
        spark.readStream.schema(schema)
        .options(**form.options())
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,txt}")
        .csv(literal_path(folder))
    )
    columns, misfits = [], []
    for field, name, kind in zip(fields, form.names, form.kinds):
        columns.append(_value(field, kind).alias(name))
        if kind != TEXT:
            misfits.append(
                F.struct(
                    F.lit(name).alias("column"), F.when(~fits(F.col(field), kind), F.col(field)).alias("text")
                )
            )
    none = F.lit(None).cast("array<struct<column:string,text:string>>")
    unfit = F.filter(F.array(*misfits), lambda item: item["text"].isNotNull()) if misfits else none
    return lines.select(
        *columns,
        F.col("_metadata.file_path").alias(SOURCE),
        F.when(F.size(unfit) > 0, unfit).otherwise(none).alias(MISFITS),
        F.col(MALFORMED),
    )


def _value(field: str, kind: str) -> Column:
    text = F.col(field)
    return text if kind == TEXT else F.when(fits(text, kind), typed(text, kind))
