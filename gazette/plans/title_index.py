"""A stored prefix index of titles: new titles meet stored ones by their rarest words, and nothing else of the index is read.

Words are put in order by how often they occurred when the order was frozen, the rarest first; words that came later count as
rarest of all. Two sets of Jaccard similarity t or more share a word among the first n - ceil(t * n) + 1 of each in any common
order, so those are a set's postings, kept by buckets of words. Of a pair that meets at places i and j of its sets, no more than
1 + min(n - i, m - j) words can be shared if this is the first word they share, and the first word of a similar pair does meet; so the
pairs that this rules out at every place are left out unseen. The rest is compared in full, with the words that postings carry.

A set of words is stored once, however many titles have it, with the owner that came first; so a family of copies is one
set, and no pairs within it are listed. Batches are numbered, and one that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Table, bucket, buckets_of
from ..streaming.seen import SeenIndex

ORDER = "token string, df long, bucket int"
POSTINGS = "token string, place int, size int, owner string, tokens array<string>, batch long, bucket int"
#: A little less than the threshold, so that rounding never shortens a prefix.
SLACK = 1e-9


def set_key(tokens: Column) -> Column:
    """The name of a set of words, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), " "), 256)


class TitleIndex:
    """Sets of words of titles under `path`, for similarities of `threshold` or more."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, buckets: int = 256):
        if not 0 < threshold <= 1:
            raise ValueError("a threshold is above 0 and at most 1")
        self.threshold, self.buckets = threshold, buckets
        self.order = Table(spark, f"{path}/order", ORDER, ("bucket",))
        self.postings = Table(spark, f"{path}/postings", POSTINGS, ("bucket",))
        self.sets = SeenIndex(spark, f"{path}/sets", buckets)

    def freeze(self, titles: DataFrame) -> None:
        """Fix the order of words by those of titles (tokens). Once only, and before any title is added: postings of another order would not meet."""
        if self.order.version().number or self.postings.version().number:
            raise ValueError("the order of words has been fixed")
        counts = titles.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        self.order.overwrite(counts.withColumn("bucket", bucket("token", self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "token"))

    def prefixes(self, sets: DataFrame, key: str) -> DataFrame:
        """(key, token, place, size, tokens, bucket): the postings of sets (key, tokens). Only the order of the sets' own words is read.

        Frequencies are looked up once for each distinct word, so a word that very many sets have is one row of the lookup;
        coming back to the sets, its side is one row and the other can be split.
        """
        sets = sets.withColumn("tokens", F.array_distinct("tokens")).filter(F.size("tokens") > 0)
        each = sets.select(key, F.explode("tokens").alias("token"))
        known = each.select("token").distinct().withColumn("bucket", bucket("token", self.buckets))
        frozen = self.order.read(only=buckets_of(known)).select("token", "df")
        df = F.coalesce("df", F.lit(0))
        ranked = each.join(known.join(frozen, "token", "left"), "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(df.alias("df"), "token", "bucket"))).alias("words"))
        keep = F.size("words") - F.ceil(F.lit(self.threshold - SLACK) * F.size("words")).cast("int") + 1
        rows = ranked.select(key, F.size("words").alias("size"), F.col("words.token").alias("tokens"), F.posexplode(F.slice("words", F.lit(1), keep)).alias("at", "w"))
        return rows.select(key, "w.token", (F.col("at") + 1).cast("int").alias("place"), "size", "tokens", "w.bucket")

    def add(self, titles: DataFrame, number: int, place: str = "owner") -> None:
        """Add the sets of titles (owner, tokens, ...) that are new; `place` tells who of a batch comes first. Titles without words are none."""
        rows = titles.filter(F.size("tokens") > 0).withColumn("key", set_key(F.col("tokens")))
        claimed = self.sets.claim(rows, number, place).filter("claimed").select("owner", "tokens", "key").dropDuplicates(["key"])
        if self.postings.version().batches.get("main", -1) >= number:
            return
        made = self.prefixes(claimed.select(F.struct("key", "owner").alias("of"), "tokens"), "of").select("token", "place", "size", F.col("of.owner").alias("owner"), "tokens", F.lit(number).cast("long").alias("batch"), "bucket")
        self.postings.append(made.repartition("bucket").sortWithinPartitions("bucket", "token"), batch=("main", number))

    def probe(self, titles: DataFrame, key: str = "key") -> DataFrame:
        """(key, owner, similarity): all stored sets that titles (key, tokens) are like. Only the buckets of their rarest words are read.

        Titles with the same words are looked up once, and what they find is joined back to each.
        """
        named = titles.select(key, set_key(F.col("tokens")).alias("of"), "tokens")
        wanted = self.prefixes(named.groupBy("of").agg(F.first("tokens").alias("tokens")), "of")
        mine = wanted.select("of", "token", F.col("place").alias("i"), F.col("size").alias("n"), F.col("tokens").alias("mine"))
        stored = self.postings.read(only=buckets_of(wanted)).select("token", F.col("place").alias("j"), F.col("size").alias("m"), "owner", F.col("tokens").alias("theirs"))
        t = F.lit(self.threshold - SLACK)
        fits = F.least("n", "m") >= t * F.greatest("n", "m")
        possible = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + 1 >= t / (1 + t) * (F.col("n") + F.col("m"))
        both = F.size(F.array_intersect("mine", "theirs"))
        met = mine.join(stored, "token").filter(fits & possible).select("of", "owner", (both / (F.col("n") + F.col("m") - both)).alias("similarity"))
        found = met.filter(F.col("similarity") >= self.threshold).distinct()
        return named.select(key, "of").join(found, "of").select(key, "owner", "similarity")
