"""String rules for names, URLs, console input and model answers.

Each helper takes a column (or its name) and returns a column built from
Spark's own functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The white space that Python's str.strip() removes (Spark's trim()
# alone only removes U+0020).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# First words that mark console input as SQL, and the words that
# close the console.
SQL_PREFIXES = ("select", "with", "show", "describe", "pragma")
EXIT_WORDS = ("exit", "quit")

# Fetch rules.
DOI_PREFIX = "https://doi.org/"
DOI_LINK_FILE = "dataset_link.txt"
UNNAMED_FILE = "downloaded_file"


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: ColumnOrName) -> Column:
    """Remove leading and trailing white space of any Unicode kind."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


def sanitize_name(name: ColumnOrName) -> Column:
    """Folder name of a protocol: ASCII letters, digits, ``-``, ``_``; spaces become ``_``."""
    kept = F.regexp_replace(_col(name), r"[^a-zA-Z0-9\-_ ]+", "")
    return F.replace(F.trim(kept), F.lit(" "), F.lit("_"))


def table_name(stem: ColumnOrName) -> Column:
    """Table name of a file stem; gets a ``t_`` prefix unless it starts with a letter."""
    name = F.lower(F.translate(_col(stem), " -", "__"))
    return F.when(name.rlike(r"^\p{L}"), name).otherwise(F.concat(F.lit("t_"), name))


def file_stem(file_name: ColumnOrName) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(_col(file_name), r"(?s)^(.+)\.[^.]*$", "$1")


def percent_decode(text: ColumnOrName) -> Column:
    """Decode ``%XX`` escapes; ``+`` and stray ``%`` signs stay as they are."""
    literal_plus = F.replace(_col(text), F.lit("+"), F.lit("%2B"))
    literal_percent = F.regexp_replace(literal_plus, r"%(?![0-9a-fA-F]{2})", "%25")
    return F.url_decode(literal_percent)


def url_file_name(url: ColumnOrName) -> Column:
    """Local file name for a URL: its decoded last segment, query string included."""
    last = percent_decode(F.substring_index(_col(url), "/", -1))
    return F.when(last == "", F.lit(UNNAMED_FILE)).otherwise(last)


def is_doi(url: ColumnOrName) -> Column:
    """True for links that are kept as links instead of being downloaded."""
    return _col(url).startswith(DOI_PREFIX)


def target_file_name(url: ColumnOrName) -> Column:
    """File a URL ends up in: the link file for a DOI, else the name from the URL."""
    return F.when(is_doi(url), F.lit(DOI_LINK_FILE)).otherwise(url_file_name(url))


def route_input(text: ColumnOrName) -> Column:
    """Class of a console input: ``ignore``, ``exit``, ``sql`` or ``natural_language``.

    The first word is matched as a prefix without a word boundary, so
    "without insulin" counts as SQL and a leading comment does not.
    """
    lowered = F.lower(strip(text))
    return (
        F.when(lowered == "", "ignore")
        .when(lowered.isin(*EXIT_WORDS), "exit")
        .when(lowered.rlike(f"^(?:{'|'.join(SQL_PREFIXES)})"), "sql")
        .otherwise("natural_language")
    )


def _drop_language_line(text: Column) -> Column:
    """Drop a first line that is only ``sql`` or ``duckdb``."""
    return F.regexp_replace(text, r"^(?i:sql|duckdb)\n", "")


FENCE = "```"


def sql_from_answer(answer: ColumnOrName) -> Column:
    """SQL of a chat answer: the first fenced block anywhere, else the bare text.

    A ``sql`` or ``duckdb`` tag of the block goes, any other stays in the text.
    """
    text = strip(answer)
    opened = F.instr(text, FENCE)
    after = F.when(opened > 0, F.substring(text, opened + len(FENCE), F.length(text)))
    block = F.substring_index(after, FENCE, 1)
    fenced = strip(F.regexp_replace(block, r"^(?i:sql|duckdb)", ""))
    bare = strip(F.replace(_drop_language_line(text), F.lit(FENCE), F.lit("")))
    return F.when(after.contains(FENCE), fenced).otherwise(bare)


def sql_from_console_answer(answer: ColumnOrName) -> Column:
    """SQL of a console answer: only a fence at the very start is unwrapped.

    With more than two lines the first and last line go, whatever they hold;
    with fewer the fence marks are deleted in place.
    """
    text = strip(answer)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    unfenced = (
        F.when(~text.startswith("```"), text)
        .when(F.size(lines) > 2, inner)
        .otherwise(F.replace(text, F.lit("```"), F.lit("")))
    )
    return _drop_language_line(unfenced)
