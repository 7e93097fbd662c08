"""Dataset catalog: rows of the public-datasets table in stored HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.types import DATASET_SCHEMA

# How the catalog page marks its table and the rows to leave out.
TABLE_ID = "ctl00_CphMain_GridViewPublicDataSets"
HEADER_ROW_CLASS = "headerstyle"
GROUP_CELL_CLASS = "GroupHeaderStyle"
PROTOCOL_CELL, DATASET_CELL, DOCUMENT_CELL, MIN_CELLS = 0, 4, 5, 6

# Elements without content, and elements whose content is no text.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
NO_TEXT_ELEMENTS = frozenset({"script", "style", "template"})


class _Cell:
    """What one table cell says: its text and the link it offers."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.seen_image = False
        self.image_alt: str | None = None
        self.data_url: str | None = None

    def link(self) -> str | None:
        return self.image_alt if self.image_alt is not None else self.data_url


class _Row:
    def __init__(self, skipped: bool) -> None:
        self.skipped = skipped
        self.cells: list[_Cell] = []


class _CatalogTable(HTMLParser):
    """Collects the rows of the first table with the catalog id."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[_Row] = []
        self._open: list[tuple[str, _Row | _Cell | None]] = []
        self._state = "before"

    def _enclosing(self, kind: type) -> list:
        return [item for _, item in self._open if isinstance(item, kind)]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {name: value or "" for name, value in attrs}
        if self._state == "before" and tag == "table" and values.get("id") == TABLE_ID:
            self._state = "inside"
        if self._state != "inside":
            return
        item: _Row | _Cell | None = None
        classes = values.get("class", "").split()
        if tag == "tr":
            item = _Row(skipped=classes == [HEADER_ROW_CLASS])
            self.rows.append(item)
        elif tag == "td":
            item = _Cell()
            for row in self._enclosing(_Row):
                row.cells.append(item)
                row.skipped = row.skipped or GROUP_CELL_CLASS in classes
        elif tag == "img":
            for cell in self._enclosing(_Cell):
                if not cell.seen_image:
                    cell.seen_image, cell.image_alt = True, values.get("alt")
        elif tag == "a" and "data-url" in values:
            for cell in self._enclosing(_Cell):
                if cell.data_url is None:
                    cell.data_url = values["data-url"]
        if tag not in VOID_ELEMENTS:
            self._open.append((tag, item))

    def handle_endtag(self, tag: str) -> None:
        if self._state != "inside":
            return
        depth = max((i for i, (name, _) in enumerate(self._open) if name == tag), default=None)
        if depth is not None:
            del self._open[depth:]
            if not self._open:
                self._state = "after"

    def handle_data(self, data: str) -> None:
        if self._state == "inside" and not NO_TEXT_ELEMENTS & {name for name, _ in self._open}:
            for cell in self._enclosing(_Cell):
                cell.text.append(data)


def datasets_in(html: str) -> list[tuple[str, str | None, str | None]]:
    """``(protocol, dataset_url, document_url)`` of each dataset row of one page."""
    page = _CatalogTable()
    page.feed(html)
    page.close()
    found = []
    for row in page.rows:
        if row.skipped or len(row.cells) < MIN_CELLS:
            continue
        protocol = "".join(row.cells[PROTOCOL_CELL].text).strip()
        if protocol:
            found.append((protocol, row.cells[DATASET_CELL].link(), row.cells[DOCUMENT_CELL].link()))
    return found


def extract_datasets(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """``(page_id, position, protocol, dataset_url, document_url)`` of all catalog pages.

    Pages without the table never leave the JVM; the rest are parsed in Arrow
    batches on the executors.
    """
    schema = T.StructType(
        [pages.schema[page_id], T.StructField("position", T.IntegerType()), *DATASET_SCHEMA.fields]
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, position, *dataset)
                for key, text in zip(batch[page_id], batch[html])
                for position, dataset in enumerate(datasets_in(text), start=1)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    catalog_pages = pages.where(F.col(html).contains(TABLE_ID)).select(page_id, html)
    return catalog_pages.mapInPandas(parse, schema).withColumns(
        {url: F.nullif(F.col(url), F.lit("")) for url in ("dataset_url", "document_url")}
    )
