"""The test tables seen as items, objects, revisions and attempts, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import format_id
from ..functions.urls import host
from . import registry as r
from .registry import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the first line is the title, the text the summary, the source a source, the language a pack."""
    d = table(spark, sf_dir, "documents")
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return d.select(F.col("doc_id").alias("rank"), title.alias("title"), F.coalesce("text", F.lit("")).alias("summary"), "source", "lang")


ITEMS = "items AS (SELECT doc_id AS rank, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS summary, source, lang FROM documents)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored objects; those that have a label have been reviewed."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = items(spark, sf_dir).join(labels, F.col("rank") == F.col("doc_id"), "left")
    n = F.col("rank")
    return d.select(
        format_id(F.lit("DOC"), F.lit(2024), n % 12 + 1, n + 1).alias("id"),
        "rank",
        "title",
        F.col("lang").alias("pack"),
        F.col("source").alias("source_name"),
        (n % 3 + 1).cast("int").alias("tier"),
        F.col("lang").alias("category"),
        F.array("source", "lang").alias("tags"),
        F.when(n % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 366).cast("int"))).alias("published_date"),
        F.date_add(F.lit("2025-01-01").cast("date"), (n % 90).cast("int")).alias("discovered_date"),
        F.col("quality").isNull().alias("needs_review"),
        F.when(n % 5 == 0, "replaced").otherwise("active").alias("status"),
        "summary",
    )


OBJECTS = f"""{ITEMS},
objects AS (
  SELECT 'DOC-2024-' || lpad((rank % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((rank + 1)::VARCHAR, greatest(3, length((rank + 1)::VARCHAR))::INT, '0') AS id, rank, title, lang AS pack, source AS source_name,
         (rank % 3 + 1)::INT AS tier, lang AS category, [source, lang] AS tags,
         CASE WHEN rank % 7 <> 0 THEN DATE '2024-01-01' + (rank % 366)::INT END AS published_date,
         DATE '2025-01-01' + (rank % 90)::INT AS discovered_date,
         rank NOT IN (SELECT doc_id FROM labels) AS needs_review,
         CASE WHEN rank % 5 = 0 THEN 'replaced' ELSE 'active' END AS status, summary
  FROM items)"""


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: an item each; its host is a pack."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("rank"), "url", host(F.col("url")).alias("pack"), "html")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as histories: a turn is a revision, its role what changed, its text the snapshot."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("turn") * 7) % 40).cast("int"))
    return c.select(
        F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("revision"), day.alias("date"), F.col("role").alias("fields"),
        F.when(F.col("turn") > 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.coalesce("text", F.lit("")).alias("snapshot"), tx.digest(F.coalesce("text", F.lit(""))).alias("content_hash"), F.col("role").alias("run_id"),
    )


REVISIONS = f"""revisions AS (
  SELECT conv_id AS id, (turn + 1)::INT AS revision, DATE '2024-01-01' + ((turn * 7) % 40)::INT AS date, role AS fields, turn > 0 AS has_changes,
         coalesce(text, '') AS snapshot, {r.digest("coalesce(text, '')")} AS content_hash, role AS run_id
  FROM conversations)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of a source: errors failed, values are what the others found."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("items"), (F.col("event_id") % 10 != 0).alias("is_primary"))


ATTEMPTS = "attempts AS (SELECT user_id AS source, ts, event_id, event_type <> 'error' AS ok, value AS items, event_id % 10 <> 0 AS is_primary FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, numbered within their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS n FROM lineitem)"
