"""Deduplication in three layers: identity, content, and titles that are nearly alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from ..plans.similarity_join import similar_pairs

NEW, KNOWN_IDENTITY, KNOWN_CONTENT, NEAR = "new", "known-identity", "known-content", "near-duplicate"
PENDING = "pending"


def against_seen(items: DataFrame, seen: DataFrame, on: str, verdict: str) -> DataFrame:
    """items with `matched`, the owner of their `on` in seen (on, owner; one row for each), and `verdict` where there is one."""
    known = seen.select(F.col(on).alias("seen_key"), F.col("owner").alias("matched"))
    found = items.join(known, items[on] == known["seen_key"], "left").drop("seen_key")
    return found.withColumn("verdict", F.when(F.col("matched").isNotNull(), verdict).otherwise(NEW))


def exact(items: DataFrame, seen_keys: DataFrame | None = None, seen_contents: DataFrame | None = None) -> DataFrame:
    """(rank, verdict, matched) for items (rank: unique order; key; content), decided one after another in order of rank.

    An item whose key is seen, before or in this run, is known-identity; else one whose content is seen, known-content; else it
    is new and claims both. seen_*: (key or content, owner) of earlier runs; what was claimed in this run is owned by `pending`.

    The new items are a greedy matching of keys and contents. In each round, every item that is the first of both its key
    and its content is new, and items that share a key or content with one are out; few rounds are left after that, and one
    where keys and contents go together.
    """
    spark = items.sparkSession
    empty = lambda c: spark.createDataFrame([], f"{c} string, owner string")
    seen_keys = empty("key") if seen_keys is None else seen_keys
    seen_contents = empty("content") if seen_contents is None else seen_contents
    old_keys, old_contents = seen_keys.select("key", F.col("owner").alias("key_owner")), seen_contents.select("content", F.col("owner").alias("content_owner"))
    items = written(items.select("rank", "key", "content").join(old_keys, "key", "left").join(old_contents, "content", "left"), "dedupe-items")
    left = items.filter("key_owner is null and content_owner is null").select("rank", "key", "content")
    claims = None
    while True:
        # Minima have partial sums, and ranks are joined by, so that a key that very many items have is no one task's.
        by_key = left.groupBy("key").agg(F.min("rank").alias("first")).select(F.col("first").alias("rank"))
        by_content = left.groupBy("content").agg(F.min("rank").alias("first")).select(F.col("first").alias("rank"))
        new = written(left.join(by_key, "rank", "left_semi").join(by_content, "rank", "left_semi").select("rank", "key", "content"), "dedupe-new")
        if new.isEmpty():
            break
        claims = new if claims is None else claims.unionByName(new)
        left = written(left.join(new.select("key"), "key", "left_anti").join(new.select("content"), "content", "left_anti"), "dedupe-left")
    if claims is None:
        claims = left.limit(0)
    by_key = claims.select("key", F.col("rank").alias("key_rank"))
    by_content = claims.select("content", F.col("rank").alias("content_rank"))
    done = items.join(by_key, "key", "left").join(by_content, "content", "left")
    new = (F.col("key_rank") == F.col("rank")) & (F.col("content_rank") == F.col("rank"))
    of_key = F.coalesce("key_owner", F.when(F.col("key_rank") < F.col("rank"), PENDING))
    of_content = F.coalesce("content_owner", F.when(F.col("content_rank") < F.col("rank"), PENDING))
    verdict = F.when(of_key.isNotNull(), KNOWN_IDENTITY).when(of_content.isNotNull(), KNOWN_CONTENT).otherwise(NEW)
    return done.select("rank", F.when(new, NEW).otherwise(verdict).alias("verdict"), F.when(~F.coalesce(new, F.lit(False)), F.coalesce(of_key, of_content)).alias("matched"))


def near(titles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(rank, matched_rank, similarity) for titles (rank; tokens, a set) that an earlier one is like: the most similar, on a tie the earliest.

    Titles of earlier runs come first in rank. Empty titles are like nothing.
    """
    pairs = similar_pairs(titles, "rank", "tokens", threshold)
    best = pairs.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("first"))).alias("best"))
    return best.select(F.col("b").alias("rank"), (-F.col("best.first")).alias("matched_rank"), F.col("best.score").alias("similarity"))


def decide(items: DataFrame, threshold: float = 0.85, seen_titles: DataFrame | None = None, **seen: DataFrame) -> DataFrame:
    """(rank, verdict, matched, similarity): all three layers over items (rank, key, content, tokens). Near duplicates are new items, flagged.

    seen_titles: (title, owner) of earlier runs, normalised; they come before all items, in order of title. Ranks are 0 or more.
    """
    first = exact(items, **seen)
    titles = first.filter(F.col("verdict") == NEW).select("rank").join(items.select("rank", "tokens"), "rank").withColumn("owner", F.lit(PENDING))
    if seen_titles is not None:
        # Increasing from partition to partition of the sorted titles; not dense, and no task has all of them.
        seen_titles = seen_titles.orderBy(F.desc("title"))
        back = F.monotonically_increasing_id() + 1
        tokens = F.array_distinct(F.filter(F.split("title", " "), lambda w: w != ""))
        titles = titles.unionByName(seen_titles.select((-back).cast("long").alias("rank"), tokens.alias("tokens"), "owner"))
    titles = written(titles, "dedupe-titles")
    flagged = near(titles, threshold).join(titles.select(F.col("rank").alias("matched_rank"), "owner"), "matched_rank")
    rows = first.join(flagged, "rank", "left")
    is_near = F.col("matched_rank").isNotNull()
    return rows.select(
        "rank",
        F.when(is_near, NEAR).otherwise(F.col("verdict")).alias("verdict"),
        F.when(is_near, F.col("owner")).otherwise(F.col("matched")).alias("matched"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def tally(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("verdict").agg(F.count("*").alias("items"))
