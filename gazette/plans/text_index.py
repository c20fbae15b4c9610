"""Substring search by an inverted index of trigrams.

Folded text is cut into all its sequences of three characters; a posting is one such gram of one object, in buckets of grams, sorted by gram
within a file. A search takes the rarest grams of what it looks for, reads their postings alone, keeps the objects that have all of
them, and looks for the whole text in those. Postings only ever rule objects out, so what has changed since is found out by that look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.snapshots import Table, bucket

GRAM = 3
#: How many grams of a search are looked up.
MOST_GRAMS = 4
POSTINGS = "gram string, id string, batch long, bucket int"
COUNTS = "gram string, n long, bucket int"


def grams(text: Column) -> Column:
    """The distinct sequences of GRAM characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


class TextIndex:
    """Postings of objects' texts under `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.postings = Table(spark, f"{path}/postings", POSTINGS, ("bucket",))
        self.counts = Table(spark, f"{path}/counts", COUNTS, ("bucket",))

    def add(self, texts: DataFrame, number: int) -> None:
        """Add texts (id, text) as batch `number`; a batch that has been added is not added again. An object whose text has changed is added once more."""
        rows = texts.select("id", F.explode(grams(fold(F.coalesce("text", F.lit(""))))).alias("gram")).withColumn("bucket", bucket("gram", self.buckets))
        batch = ("main", number)
        if self.postings.version().batches.get("main", -1) < number:
            # The commonest gram is in every object: dealt by a salt as well, a bucket is several files.
            dealt = rows.withColumn("batch", F.lit(number).cast("long")).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
            self.postings.append(dealt.sortWithinPartitions("bucket", "gram", "id"), batch=batch)
        made = self.postings.read().filter(F.col("batch") == number)
        self.counts.append(made.groupBy("gram", "bucket").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram"), batch=batch)

    def _wanted(self, folded: str) -> list[tuple[str, int]] | None:
        """The rarest grams of a text, rarest first, with their buckets; None where one of its grams is in no object."""
        all_grams = sorted({folded[k : k + GRAM] for k in range(len(folded) - GRAM + 1)})
        placed = self.spark.createDataFrame([(g,) for g in all_grams], "gram string").select("gram", bucket("gram", self.buckets).alias("bucket")).collect()
        counted = self.counts.read(only={(r.bucket,) for r in placed}).filter(F.col("gram").isin(all_grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        n = {r.gram: r.n for r in counted}
        if len(n) < len(all_grams):
            return None
        return [(r.gram, r.bucket) for r in sorted(placed, key=lambda r: (n[r.gram], r.gram))[:MOST_GRAMS]]

    def candidates(self, text: str) -> DataFrame | None:
        """(id) of the objects that have the rarest grams of a text; None where the text is too short for grams, so that all objects are candidates."""
        folded = self.spark.range(1).select(fold(F.lit(text))).first()[0]
        if len(folded) < GRAM:
            return None
        wanted = self._wanted(folded)
        if wanted is None:
            return self.spark.createDataFrame([], "id string")
        rows = self.postings.read(only={(b,) for _, b in wanted}).filter(F.col("gram").isin([g for g, _ in wanted]))
        return rows.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def search(self, objects: DataFrame, text: str, haystack: Column) -> DataFrame:
        """The objects whose folded haystack has the folded text; those and no others, as long as every object has been added."""
        found = self.candidates(text)
        hit = F.contains(fold(haystack), fold(F.lit(text)))
        return (objects if found is None else objects.join(found, "id", "left_semi")).filter(hit)
