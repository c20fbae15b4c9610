"""RSS and Atom feeds, through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import feed_date
from ..functions.html import html_to_text
from .items import Source, as_items

RSS = "title string, link string, description string, `content:encoded` string, guid string, pubDate string, category array<string>"
ATOM = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, id string, published string, updated string, category array<struct<_term:string>>"


class SourceError(RuntimeError):
    pass


def read_feed(spark: SparkSession, path: str, source: Source, most: int = 120) -> DataFrame:
    """Items of the feed files at `path`. A feed without entries is an error: sources do not run dry, they break."""
    atom = source.kind == "atom"
    schema = ATOM if atom else RSS
    rows = spark.read.schema(schema).option("rowTag", "entry" if atom else "item").option("ignoreNamespace", "false").option("mode", "PERMISSIVE").xml(path)
    if rows.isEmpty():
        raise SourceError(f"no entries in the feed of {source.name}")
    if atom:
        links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link, ident, bodies, tags = F.get(links, F.lit(0))["_href"], F.col("id"), ["summary", "content"], F.transform("category", lambda x: x["_term"])
        date = feed_date(F.col("published"), F.col("updated"))
    else:
        link, ident, bodies, tags = F.col("link"), F.col("guid"), ["description", "`content:encoded`"], F.col("category")
        date = feed_date(F.col("pubDate"), F.lit(None).cast("string"))
    longest = F.array_max(F.array(*[F.struct(F.length(F.coalesce(b, F.lit(""))).alias("n"), F.coalesce(b, F.lit("")).alias("b")) for b in bodies]))["b"]
    tags = F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))))
    return as_items(rows, source, link=link, title=F.coalesce("title", F.lit("")), summary=html_to_text(longest), date=date, tags=tags, method="feed-entry", selector=F.lit(None).cast("string"), source_id=ident, most=most)
