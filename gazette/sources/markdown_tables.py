"""Tables of Markdown documents. Native throughout: lines, a window for the running section, arrays of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_markdown
from ..functions.urls import doc_link
from .items import Source, table_items

HEADERS = ("title", "feature", "description", "month", "date", "update", "name", "learn more", "details")
LINK = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'


def table_rows(documents: DataFrame, doc_path: str, docs_prefix: str, base_url: str) -> DataFrame:
    """(cells, links, section, row) of the table rows in documents (path, value: whole text), header and ruler rows left out."""
    lines = documents.select("path", F.posexplode(F.split("value", "\r?\n")).alias("row", "line"))
    heading = F.regexp_extract("line", r"^#{2,4}\s+(.+?)\s*$", 1)
    upto = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(heading != "", heading), ignorenulls=True).over(upto))
    return cells_of(lines, F.lit(doc_path.rpartition("/")[0]), F.lit(docs_prefix), F.lit(base_url)).select("cells", "links", "section", "row")


def cells_of(lines: DataFrame, folder: Column, docs_prefix: Column, base_url: Column) -> DataFrame:
    """The lines (line, ...) that are table rows, with cells and links; header and ruler rows are left out."""
    rows = lines.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    raw = F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|")
    rows = rows.withColumn("cells", F.transform(raw, strip_markdown))
    found = F.transform(F.regexp_extract_all("line", F.lit(f"({LINK})"), 1), lambda x: F.struct(doc_link(F.regexp_extract(x, LINK, 2), folder, docs_prefix, base_url).alias("target"), strip_markdown(F.regexp_extract(x, LINK, 1)).alias("label")))
    rows = rows.withColumn("links", F.filter(found, lambda x: x["target"].isNotNull()))
    header = F.forall("cells", lambda c: (c == "") | F.lower(c).isin(*HEADERS))
    return rows.filter(~header)


def read_markdown(spark: SparkSession, path: str, source: Source, most: int = 120) -> DataFrame:
    """Items of the Markdown documents at `path`. The option rendered_base_url tells where they are published; without it links mean nothing."""
    options = source.options
    if not options.get("rendered_base_url"):
        raise ValueError(f"{source.name} needs the option rendered_base_url")
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = table_rows(documents, options.get("doc_path", ""), options.get("docs_prefix", ""), options["rendered_base_url"])
    return table_items(rows, source, "markdown-table-row", most)
