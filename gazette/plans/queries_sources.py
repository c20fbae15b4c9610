"""Queries over files that Spark derives from the tables and that sources read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import landed
from ..sources.items import Source
from . import registry as r
from .registry import query, table
from .shared import local_path, shared_dir

#: What XML has no way to write.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_PLAIN = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def write_feeds(docs: DataFrame, path: str) -> None:
    """The documents as RSS, a file for each of as many groups of identifiers as there are shuffle partitions."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), CONTROLS, " ")
    field = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    ident = F.col("doc_id").cast("string")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(
        field("title", _escaped(F.split(text, "\n")[0])), field("link", F.concat(F.lit("https://docs.example/"), ident, F.lit("?utm_source=feed"))), field("guid", ident),
        field("pubDate", F.concat(day, F.lit(" 10:00:00 GMT"))), field("description", _escaped(_escaped(text))),
    )
    feed = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    lines = docs.select(feed.alias("feed"), F.lit(1).alias("place"), field("item", item).alias("value"))
    for place, value in ((0, "<rss><channel>"), (2, "</channel></rss>")):
        lines = lines.unionByName(docs.select(feed.alias("feed")).distinct().select("feed", F.lit(place).alias("place"), F.lit(value).alias("value")))
    lines.repartition(n, "feed").sortWithinPartitions("feed", "place").select("feed", "value").write.partitionBy("feed").text(path)


@query(
    f"SELECT 'https://docs.example/' || doc_id AS announcement_url, {r.line('split_part(' + _PLAIN + ', chr(10), 1)')} AS title, DATE '2024-01-01' + (doc_id % 366)::INT AS published_date, "
    f"{r.truncated(_PLAIN, 120)} AS summary, doc_id::VARCHAR AS guid FROM documents"
)
def landed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as feeds and read back by the data source of landed files."""
    path = f"{shared_dir(spark)}/gazette/feeds-{uuid.uuid4().hex}"
    write_feeds(table(spark, sf_dir, "documents"), path)
    found = landed.read_items(spark, [Source("docs", "https://docs.example/feed", "rss")], lambda _: local_path(path))
    guid = F.substring_index("announcement_url", "/", -1)
    return found.select("announcement_url", "title", "published_date", "summary", guid.alias("guid"))
