"""Ad-hoc SQL that can only read."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# Statements that only show metadata; everything else must be a query.
_METADATA = re.compile(r"(?is)^(?:show|describe|desc|explain)\b")
_LEADING = re.compile(r"(?s)^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)+")
_TRAILING = re.compile(r"(?s);(?:\s+|;|--[^\n]*(?:\n|$)|/\*.*?\*/)*$")
# Functions that call arbitrary Java methods, in any quoting, outside of texts and comments.
_REFLECTIVE = re.compile(r"(?i)\b(?:reflect|try_reflect|java_method)\s*\(")
_TEXTS = re.compile(r"""(?s)'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""")
_ON_FILES = "spark.sql.runSQLOnFiles"


class NotReadOnly(ValueError):
    """The text is not a single read-only statement."""


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Result of one read-only statement; Spark's own errors pass through.

    A query runs as a common table expression inside ``SELECT * FROM (..)``:
    Spark's grammar admits no INSERT, DDL, SET or second statement there, so the
    parser itself refuses everything that writes, including ``WITH .. INSERT``.
    SHOW, DESCRIBE and EXPLAIN run as they are. Calls of Java methods and tables named
    by a file path are refused. A statement runs in a copy of the session with the same
    views and settings, so statements may run side by side and change nothing for others.
    """
    body = _TRAILING.sub("", _LEADING.sub("", text)).strip()
    if not body:
        raise NotReadOnly("empty statement")
    if _REFLECTIVE.search(_TEXTS.sub(" ", body).replace("`", "")):
        raise NotReadOnly("calls of Java methods are refused")
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(_ON_FILES, "false")
    try:
        if _METADATA.match(body):
            return own.sql(body)
        return own.sql(f"SELECT * FROM (WITH read_only AS (\n{body}\n) SELECT * FROM read_only)")
    except ParseException as error:
        raise NotReadOnly(f"not a single read-only query: {error}") from error
