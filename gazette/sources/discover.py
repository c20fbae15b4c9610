"""Polling sources: each chain of fallbacks until one delivers, every attempt recorded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import written
from ..schema import ITEM_COLUMNS
from .feeds import read_feed
from .html_tables import read_html
from .items import Source
from .landed import MANUAL, items, links_option, read_entries
from .markdown_tables import read_markdown

#: Readers of one source each, through Spark's own file sources; landed.read_entries() reads all at once.
READERS: dict[str, Callable[..., DataFrame]] = {"rss": read_feed, "atom": read_feed, "commits": read_feed, "markdown": read_markdown, "html": read_html}
ATTEMPTS = "source string, position int, name string, role string, ok boolean, items long, reason string"


@dataclass
class Discovery:
    """items: of all sources that delivered; null if none did. attempts: a row for each try. unresolved: sources that a person must look at."""

    items: DataFrame | None
    attempts: DataFrame
    unresolved: list[str]


def discover(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str], most: int = 120) -> Discovery:
    """Read what has landed for each polled source. landed(source) is the path of its fetched files; it may raise."""
    items, attempts, unresolved = None, [], []
    for source in (s for s in sources if s.polled):
        for k, link in enumerate(source.chain()):
            if link.role == MANUAL:
                unresolved.append(source.name)
                break
            try:
                found = READERS[link.kind](spark, landed(link), link, most)
                n = found.count()
            except Exception as e:  # whatever a source does wrong is its own failure, not the run's
                attempts.append((source.name, k, link.name, link.role, False, 0, str(e)[:500]))
                continue
            attempts.append((source.name, k, link.name, link.role if k == 0 else "secondary", True, n, None))
            items = found if items is None else items.unionByName(found)
            break
        else:
            unresolved.append(source.name)
    if items is not None:
        items = items.orderBy(F.col("published_date").asc_nulls_last(), "identity.key")
    return Discovery(items, spark.createDataFrame(attempts, ATTEMPTS), unresolved)


def discover_at_once(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str], most: int = 120) -> Discovery:
    """discover() as one scan over all links of all sources, a task for each file. items come unordered.

    A link with a file that cannot be read, or without files, has failed, as a whole; of a source's links the first that has
    not failed delivers, and the links after it are no attempts.
    """
    import json

    from pyspark.sql import Window

    links = json.loads(links_option(sources, landed))
    wanted = [s for s in sources if s.polled]
    if not links:
        return Discovery(None, spark.createDataFrame([], ATTEMPTS), [s.name for s in wanted])
    entries = written(read_entries(spark, sources, landed), "entries")
    found = written(items(entries, most), "items")
    counts = found.groupBy("source", "position").agg(F.count("*").alias("items"))
    broken = entries.filter("error is not null").groupBy("source", "position").agg(F.min_by("error", F.coalesce("file", F.lit(""))).alias("reason"))
    of = spark.createDataFrame([(k["source"], k["position"], k["name"], k["role"]) for k in links], "source string, position int, name string, role string")
    tried = of.join(counts, ["source", "position"], "left").join(broken, ["source", "position"], "left").withColumn("ok", F.col("reason").isNull())
    before = Window.partitionBy("source").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # a chain's links
    tried = tried.withColumn("done", F.coalesce(F.max("ok").over(before), F.lit(False))).filter("not done")
    role = F.when(F.col("ok") & (F.col("position") > 0), "secondary").otherwise(F.col("role"))
    n = F.when(F.col("ok"), F.coalesce("items", F.lit(0))).otherwise(0).cast("long")
    attempts = written(tried.select("source", "position", "name", role.alias("role"), "ok", n.alias("items"), "reason"), "attempts")
    delivered = {r[0] for r in attempts.filter("ok").select("source").collect()}  # sources are configuration
    chosen = found.join(attempts.filter("ok").select("source", "position"), ["source", "position"], "left_semi")
    return Discovery(chosen.select(*ITEM_COLUMNS) if delivered else None, attempts, [s.name for s in wanted if s.name not in delivered])
