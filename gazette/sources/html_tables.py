"""Tables of HTML pages. HTML as it is found is no XML, so rows come from html.parser, in Arrow batches; the rest is native."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .items import Source, table_items

ROWS = "cells array<string>, links array<struct<target:string,label:string>>, section string, row int"
NO_SECTION = "in this article"


class _Tables(HTMLParser):
    """Collects (cells, links, section) of each table row that has a cell that is no header."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.section, self.rows = base, "", []
        self.heading: list[str] | None = None
        self.cells: list[list[str]] | None = None
        self.links: list[list] = []
        self.in_cell = self.in_link = self.data_cell = False

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3"):
            self.heading = []
        elif tag == "tr":
            self.cells, self.links, self.data_cell = [], [], False
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append([])
            self.in_cell = True
            self.data_cell |= tag == "td"
        elif tag == "a" and self.in_cell and (href := dict(attrs).get("href")):
            self.links.append([urljoin(self.base, href), []])
            self.in_link = True

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            name = " ".join("".join(self.heading).split())
            if name.lower() != NO_SECTION:
                self.section = name
            self.heading = None
        elif tag in ("td", "th"):
            self.in_cell = self.in_link = False
        elif tag == "a":
            self.in_link = False
        elif tag == "tr" and self.cells is not None:
            if self.data_cell:
                line = lambda parts: " ".join("".join(parts).split())
                self.rows.append(([line(c) for c in self.cells], [{"target": t, "label": line(x)} for t, x in self.links], self.section))
            self.cells = None

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        if self.in_cell and self.cells:
            self.cells[-1].append(data)
        if self.in_link and self.links:
            self.links[-1][1].append(data)


def table_rows(pages: DataFrame) -> DataFrame:
    """(cells, links, section, row) of the table rows in pages (base, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("target", pa.string()), ("label", pa.string())]))
        for batch in batches:
            found = []
            for base, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = _Tables(base or "")
                parser.feed(html or "")
                found += [(*r, k) for k, r in enumerate(parser.rows)]
            kinds = (pa.list_(pa.string()), link, pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["cells", "links", "section", "row"])

    return pages.select("base", "html").mapInArrow(run, ROWS)


def read_html(spark: SparkSession, path: str, source: Source, most: int = 120) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(F.lit(source.url).alias("base"), F.col("value").alias("html"))
    return table_items(table_rows(pages), source, "html-table-row", most)
