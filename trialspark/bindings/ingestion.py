"""Ingestion queries: sample tables written as messy exports and loaded back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import query, table
from trialspark.functions.text import sanitize_name, table_name
from trialspark.operators.harmonize import harmonize
from trialspark.plans.fetch import fetch_manifest
from trialspark.plans.load import load_folder
from trialspark.plans.store import FolderStore
from trialspark.session import new_workspace
from trialspark.sources.archives import expand_archives
from trialspark.sources.catalog_pages import TABLE_ID, extract_datasets
from trialspark.sources.discovery import list_files
from trialspark.sources.files import copy_files, resolve

# Text as other programs export it: quotes doubled, blanks and line ends kept.
_EXPORT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _load_back(spark: SparkSession, exports: dict[str, DataFrame], loaded: str, **options: str) -> DataFrame:
    """Write exports as delimited text, load the folder, return one loaded table."""
    work = new_workspace(spark, "ingest")
    for name, df in exports.items():
        df.write.options(**{**_EXPORT, **options}).csv(f"{work}/in/{name}")
    store = FolderStore(spark, f"{work}/tables")
    load_folder(spark, f"{work}/in", store)
    return store.read(loaded)


@query(
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
)
def ingest_pipe(spark: SparkSession, folder: str) -> DataFrame:
    return _load_back(spark, {"Customer.csv": table(spark, folder, "customer")}, "customer", sep="|")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def ingest_tab(spark: SparkSession, folder: str) -> DataFrame:
    return _load_back(spark, {"2 Part-list.txt": table(spark, folder, "part")}, "t_2_part_list", sep="\t")


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    o_orderdate::DATE AS order_day, o_orderpriority, lpad(o_custkey::VARCHAR, 8, '0') AS subject_id
    FROM orders"""
)
def ingest_comma(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.to_date("o_orderdate").alias("order_day"),
        "o_orderpriority",
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("subject_id"),
    )
    return _load_back(spark, {"orders.csv": orders}, "orders")


@query("SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations")
def ingest_utf16(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as UTF-16 text, with line ends, separators and quotes inside quoted fields."""
    # A byte-order mark in front of the header makes each part file start with FF FE.
    turns = table(spark, folder, "conversations").withColumnRenamed("conv_id", "\ufeffconv_id")
    return _load_back(spark, {"turns.txt": turns}, "turns", sep="|", encoding="UTF-16LE")


# A note that holds quotes in every 40th document only, written as one line.
SQL_LATE_NOTE = r"""CASE WHEN doc_id % 40 = 7 THEN 'says {q}so{q}, then ' ELSE 'notes ' END ||
    translate(coalesce(text, ''), chr(10) || chr(13) || '",' || chr(39) || chr(92), '      ')"""


@query(
    f"""SELECT 'backslash' AS form, doc_id, {SQL_LATE_NOTE.format(q='"')} AS note FROM documents
    UNION ALL SELECT 'single', doc_id, {SQL_LATE_NOTE.format(q="''")} FROM documents"""
)
def ingest_late_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Exports whose first quoted field follows thousands of plain lines."""
    docs = table(spark, folder, "documents")
    plain = F.translate(F.coalesce("text", F.lit("")), "\n\r\",'\\", "      ")
    loaded = []
    for form, quote in (("backslash", '"'), ("single", "'")):
        late = F.col("doc_id") % 40 == 7
        start = F.when(late, f"says {quote}so{quote}, then ").otherwise("notes ")
        notes = docs.select("doc_id", F.concat(start, plain).alias("note"), late.alias("late"))
        # Plain lines come first; a writer quotes the late ones alone, as they hold a comma.
        notes = notes.orderBy("late", "doc_id").drop("late")
        back = _load_back(spark, {"notes.csv": notes}, "notes", quote=quote, escape="\\")
        loaded.append(back.select(F.lit(form).alias("form"), "doc_id", "note"))
    return loaded[0].union(loaded[1])


@query("SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def ingest_multiline(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes, separators and line ends inside quoted fields."""
    return _load_back(spark, {"documents.csv": table(spark, folder, "documents")}, "documents")


@query(
    """SELECT o_orderkey AS amount, o_custkey AS subject, o_orderstatus, o_totalprice, o_orderdate,
    o_orderpriority AS o_orderpriority FROM orders"""
)
def harmonize_columns(spark: SparkSession, folder: str) -> DataFrame:
    synonyms = {"amount": ["O_ORDERKEY", "o_totalprice"], "subject": ["o_custkey", "pt_id"]}
    return harmonize(table(spark, folder, "orders"), synonyms)


@query(
    """SELECT * FROM (
    SELECT 'orders.csv' AS name, 'orders' AS "table", 'utf-8' AS encoding, ',' AS sep,
        'loaded' AS status, NULL AS error, (SELECT count(*) FROM orders) AS n_rows, 0 AS n_ragged
    UNION ALL SELECT 'orders.txt', 'orders', 'utf-8', '|', 'skipped', NULL, NULL, NULL
    UNION ALL SELECT 'Latin-1.csv', 'latin_1', 'utf-8', ',', 'failed',
        'invalid unicode: the file is not UTF-8', NULL, NULL
    UNION ALL SELECT 'Ragged.csv', 'ragged', 'utf-8', ',', 'loaded', NULL, (SELECT count(*) FROM orders),
        (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 3)
    UNION ALL SELECT '3 Sites.csv', 't_3_sites', 'utf-8', chr(9), 'loaded', NULL,
        (SELECT count(*) FROM supplier), 0
    UNION ALL SELECT 'Subjects.txt', 'subjects', 'utf-16', '|', 'loaded', NULL,
        (SELECT count(*) FROM customer), 0
    UNION ALL SELECT '_Regions.csv', 't__regions', 'utf-8', ',', 'loaded', NULL, (SELECT count(*) FROM region), 0
    UNION ALL SELECT 'Parts.csv', 'parts', 'utf-8', ',', 'loaded', NULL, (SELECT count(*) FROM part), 0
    UNION ALL SELECT '.texts.csv', 't_.texts', 'utf-8', ',', 'loaded', NULL, (SELECT count(*) FROM documents), 0
    )"""
)
def load_report(spark: SparkSession, folder: str) -> DataFrame:
    work = new_workspace(spark, "report")
    orders = table(spark, folder, "orders")
    sites = table(spark, folder, "supplier")
    texts = table(spark, folder, "documents").select("doc_id", F.lit("é").alias("mark"), "lang")

    def export(df: DataFrame, name: str, **options: str) -> None:
        df.write.options(**{**_EXPORT, **options}).csv(f"{work}/in/{name}")

    export(orders, "orders.csv")
    export(orders, "a/orders.txt", sep="|")
    export(texts, "Latin-1.csv", encoding="ISO-8859-1")
    ragged = F.col("o_orderkey") % 5 == 3
    extra = F.when(ragged, ",odd").otherwise("")
    lines = orders.orderBy(ragged, "o_orderkey").select(F.concat("o_orderkey", F.lit(","), "o_orderstatus", extra))
    lines.write.text(f"{work}/in/Ragged.csv")
    export(sites, "3 Sites.csv", sep="\t")
    export(sites, "Sites Glossary.csv")
    subjects = table(spark, folder, "customer")
    marked = subjects.withColumnRenamed("c_custkey", "\ufeffc_custkey")
    export(marked, "b/Subjects.txt", sep="|", encoding="UTF-16LE")
    # Names that Spark's own sources pass over: a single file, a folder, and a file in one.
    export(table(spark, folder, "region").coalesce(1), "../aside.csv")
    parts = list_files(spark, f"{work}/aside.csv", ".csv").where(F.col("path").contains("/part-"))
    copy_files(spark, {row["path"]: f"{work}/in/c/_Regions.csv" for row in parts.collect()})
    export(table(spark, folder, "part"), "_d/Parts.csv")
    export(table(spark, folder, "documents"), ".h/_e/.texts.csv")
    report = load_folder(spark, f"{work}/in", FolderStore(spark, f"{work}/tables"))
    name = F.substring_index("path", "/", -1).alias("name")
    return report.select(name, *(c for c in report.columns if c != "path"))


@query(
    r"""SELECT doc_id, replace(trim(regexp_replace(text, '[^a-zA-Z0-9\-_ ]', '', 'g')), ' ', '_') AS folder
    FROM documents"""
)
def sanitize_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", sanitize_name("text").alias("folder"))


@query(
    """SELECT p_partkey,
    't_' || lower(replace(replace(p_partkey || ' ' || p_name || '-' || p_brand, ' ', '_'), '-', '_')) AS numbered,
    lower(replace(replace(p_type || '-' || p_name, ' ', '_'), '-', '_')) AS named
    FROM part"""
)
def table_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        table_name(F.concat("p_partkey", F.lit(" "), "p_name", F.lit("-"), "p_brand")).alias("numbered"),
        table_name(F.concat("p_type", F.lit("-"), "p_name")).alias("named"),
    )


@query(
    r"""WITH datasets AS (
        SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS protocol, url AS dataset_url,
            CASE WHEN url LIKE '%#top' THEN 'https://doi.org/10.1000/' || page_id
                 WHEN url LIKE '%ref=%' THEN url || '/Data%20set%C3%A9+' || page_id || '.zip' END AS document_url
        FROM pages
    ), requests AS (
        SELECT page_id, protocol, 1 AS step, 'dataset' AS kind, dataset_url AS url FROM datasets
        UNION ALL SELECT page_id, protocol, 2, 'document', document_url FROM datasets WHERE document_url IS NOT NULL
    ), targets AS (
        SELECT *, 'data/' || replace(trim(regexp_replace(protocol, '[^a-zA-Z0-9\-_ ]', '', 'g')), ' ', '_') || '/' ||
            CASE WHEN url LIKE 'https://doi.org/%' THEN 'dataset_link.txt'
                 WHEN url LIKE '%/' THEN 'downloaded_file'
                 ELSE url_decode(split_part(url, '/', -1)) END AS target
        FROM requests
    ), listing AS (
        SELECT DISTINCT target FROM targets WHERE step = 1 AND url LIKE 'http://%'
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY target ORDER BY page_id, step) AS n FROM targets
    )
    SELECT page_id, kind, url, target,
        CASE WHEN n > 1 OR target IN (SELECT target FROM listing) THEN 'skip_exists'
             WHEN url LIKE 'https://doi.org/%' THEN 'save_link' ELSE 'download' END AS action
    FROM numbered""",
    name="fetch_manifest",
)
def fetch_plan(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    url = F.col("url")
    datasets = pages.select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("protocol"),
        url.alias("dataset_url"),
        F.when(url.endswith("#top"), F.concat(F.lit("https://doi.org/10.1000/"), "page_id"))
        .when(
            url.contains("ref="),
            F.concat("url", F.lit("/Data%20set%C3%A9+"), "page_id", F.lit(".zip")),
        )
        .alias("document_url"),
    )
    # Files that an earlier run fetched: everything from plain http addresses.
    host = F.regexp_replace(F.regexp_extract("url", r"^http://([^/]+)", 1), r"[^a-zA-Z0-9\-_ ]", "")
    file = F.substring_index("url", "/", -1)
    existing = pages.where(url.startswith("http://")).select(
        F.concat(
            F.lit("data/"), host, F.lit("/"), F.when(file == "", "downloaded_file").otherwise(file)
        ).alias("target")
    )
    return fetch_manifest(datasets, "page_id", existing, "data")


@query(
    """SELECT page_id, 1 AS position, 'Trial ' || page_id || ' & co' AS protocol, url AS dataset_url,
        'https://doi.org/' || page_id AS document_url FROM pages
    UNION ALL
    SELECT page_id, 2, 'Follow-up ' || page_id, NULL, url || '#doc' FROM pages"""
)
def catalog_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog tables appended to the raw HTML of every page, among rows to be left out."""
    filler = "<td>1</td><td>2</td><td>3</td>"
    rows = F.concat(
        F.lit(f'<table id="{TABLE_ID}"><tr class="headerstyle"><td>Protocol</td>{filler}{filler}</tr>'),
        F.lit('<tr><td class="GroupHeaderStyle">Group</td></tr><tr><td>short</td></tr>'),
        F.lit("<tr><td> Trial <b>"),
        "page_id",
        F.lit(f'</b> &amp; co </td>{filler}<td><img src="x.png" alt="'),
        F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit('"></td><td><a data-url="https://doi.org/'),
        "page_id",
        F.lit(f'">doc</a></td></tr><tr><td>  </td>{filler}<td></td><td></td></tr><tr><td>Follow-up '),
        "page_id",
        F.lit(f'</td>{filler}<td><img alt=""></td><td><img src="y.png"><a data-url="'),
        "url",
        F.lit('#doc">x</a></td></tr></table><table><tr><td>after</td></tr></table>'),
    )
    pages = table(spark, folder, "pages").select("page_id", F.concat("html", rows).alias("html"))
    return extract_datasets(pages, "page_id")


# Archives of each kind that the report is made of.
N_ARCHIVES = 8


def _zipped(members: dict[str, bytes], damaged: bool = False) -> bytes:
    """A small archive; ``damaged`` spoils the content of its last member."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as zipped:
        for name, content in members.items():
            zipped.writestr(name, content)
    data = held.getvalue()
    if damaged:
        at = data.rindex(content)
        data = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    return data


def _write_archives(df: DataFrame, root: str) -> DataFrame:
    """One zip with one CSV per partition, and next to it archives that go wrong in every way."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        system, path = resolve(root)
        beside = {
            f"broken-{part}.zip": b"no archive",
            f"empty-{part}.zip": _zipped({}),
            f"damaged-{part}.zip": _zipped({"good.txt": b"good", "bad.txt": b"spoiled"}, damaged=True),
            f"done-{part}.zip": _zipped({"new.txt": b"new"}),
            f"done-{part}/old.txt": b"old",
        }
        system.create_dir(f"{path}/done-{part}", recursive=True)
        for name, content in beside.items():
            with system.open_output_stream(f"{path}/{name}") as sink:
                sink.write(content)
        written = 0
        with (
            system.open_output_stream(f"{path}/export {part}.zip") as sink,
            zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as zipped,
            zipped.open(f"site/rows-{part}.csv", "w") as member,
            io.TextIOWrapper(member, encoding="utf-8", newline="") as text,
        ):
            for batch in batches:
                batch.to_csv(text, index=False, header=written == 0)
                written += len(batch)
        yield pd.DataFrame({"n": [written]})

    return df.repartition(N_ARCHIVES).mapInPandas(write, "n long")


@query(
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    name="expand_archives",
)
def archive_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Archives written from a table, unpacked, and their members read back."""
    customers = table(spark, folder, "customer")
    work = new_workspace(spark, "archives")
    _write_archives(customers, work).agg(F.sum("n")).first()
    expand_archives(spark, work)
    return (
        spark.read.schema(customers.schema)
        .options(header=True, recursiveFileLookup=True, pathGlobFilter="rows-*.csv")
        .csv(work)
    )


@query(
    f"""SELECT * FROM (VALUES
        ('extracted', 'export', {N_ARCHIVES}, {N_ARCHIVES}, NULL),
        ('extracted', 'empty', {N_ARCHIVES}, 0, NULL),
        ('failed', 'broken', {N_ARCHIVES}, 0, 'Bad Zip File'),
        ('failed', 'damaged', {N_ARCHIVES}, {N_ARCHIVES}, 'Bad Zip File'),
        ('held_back', 'damaged', {N_ARCHIVES}, {N_ARCHIVES}, NULL),
        ('skipped', 'done', {N_ARCHIVES}, 0, NULL)
    ) AS outcome(status, kind, n_archives, n_members, error),
    (SELECT count(*) AS n_rows FROM orders) AS unpacked"""
)
def archive_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every outcome an archive or a member can have, beside the number of unpacked rows."""
    orders = table(spark, folder, "orders")
    work = new_workspace(spark, "archives")
    _write_archives(orders, work).agg(F.sum("n")).first()
    report = expand_archives(spark, work)
    lines = (
        spark.read.options(recursiveFileLookup=True, pathGlobFilter="rows-*.csv", header=True)
        .schema("o_orderkey long")
        .csv(work)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    kind = F.regexp_extract("archive", r"/([a-z]+)[^/]*$", 1).alias("kind")
    return report.groupBy("status", kind).agg(
        F.count_distinct("archive").alias("n_archives"),
        F.count("member").alias("n_members"),
        F.max("error").alias("error"),
        F.max(lines.scalar()).alias("n_rows"),
    )
