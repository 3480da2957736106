"""Spreadsheet and paged sources as Python data sources."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.sources.scratch import Tables

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    number = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def worksheet_rows(content: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[dict[str, str]]:
    """Rows of a worksheet by the names in its first row; rows without a first column are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{_NS}c"):
                if cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                else:
                    node = cell.find(f"{_NS}v")
                    value = "" if node is None or node.text is None else node.text
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                cells[_column_number(cell.get("r"))] = value
            rows.append(cells)
    if not rows:
        return []
    names = rows[0]
    return [{name: r.get(k, "") for k, name in names.items()} for r in rows[1:] if r.get(0)]


def read_workbook(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first worksheets of workbooks, all columns strings; each workbook is parsed in one task."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(worksheet_rows(content), columns=columns, dtype=object).fillna("")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


class _Page(InputPartition):
    def __init__(self, index: int):
        super().__init__(index)
        self.index = index


class PagedSource(DataSource):
    """Rows from pages that a client fetches: `fetch(page, size)` gives a page's rows.

    The client is injected (a web API, a saved replay); each page is a partition and is tried
    again with growing pauses. Options: pages, page_size, retries.
    """

    client: Callable[[int, int], list[tuple]] | None = None
    columns = "value string"

    @classmethod
    def name(cls) -> str:
        return "loomgraph_pages"

    def schema(self) -> str:
        return type(self).columns

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).client, {k: int(v) for k, v in self.options.items() if str(v).isdigit()})


class _PagedReader(DataSourceReader):
    def __init__(self, client, options: dict[str, int]):
        self.client, self.pages = client, options.get("pages", 1)
        self.size, self.retries = options.get("page_size", 1000), options.get("retries", 5)

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time

        for attempt in range(self.retries):
            try:
                yield from self.client(partition.index, self.size)
                return
            except OSError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(min(10.0, 0.1 * 2**attempt))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[tuple]], columns: str, pages: int, page_size: int = 1000, retries: int = 5) -> DataFrame:
    """A DataFrame of all pages of a client."""
    source = type("Pages", (PagedSource,), {"client": staticmethod(fetch), "columns": columns})
    spark.dataSource.register(source)
    return spark.read.format("loomgraph_pages").option("pages", pages).option("page_size", page_size).option("retries", retries).load()


def all_pages(spark: SparkSession, fetch: Callable[[int, int], list[tuple]], columns: str, page_size: int = 1000, at_once: int = 8, retries: int = 5) -> DataFrame:
    """A DataFrame of a client's pages up to the first that isn't full. Pages are fetched at_once together and written, so none is fetched twice."""
    tables, out, first = Tables(spark, "pages"), None, 0
    while True:
        wave = tables.write(paged(spark, functools.partial(_shifted, fetch, first), columns, at_once, page_size, retries), f"from-{first}")
        out = wave if out is None else out.unionByName(wave)
        first += at_once
        if wave.count() < at_once * page_size:
            return out


def _shifted(fetch: Callable[[int, int], list[tuple]], first: int, page: int, size: int) -> list[tuple]:
    return fetch(first + page, size)
