"""What has been seen in any run: keys with their owners, in buckets, and batches that claim them once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import MOST_PARTS, Table, Version, bucket, buckets_of

SCHEMA = "key string, owner string, stream string, batch long, bucket int"
STREAM = "main"


class SeenIndex:
    """Keys and who owns them, for good. Only the buckets of a batch's keys are read and added to.

    A batch is committed with its number in one step, so a batch that failed before has claimed nothing, and one that comes again, whether
    it failed later or is replayed, gets the answers that it got first. Batches of one stream come in the order of their numbers.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.table, self.buckets = Table(spark, path, SCHEMA, ("bucket",)), buckets

    def bucket(self, key: Column | str) -> Column:
        return bucket(key, self.buckets)

    def owners(self, keys: DataFrame) -> DataFrame:
        """(key, owner) of those keys (key) that are in the index."""
        placed = keys.select("key").distinct().withColumn("bucket", self.bucket("key"))
        return self.table.read(only=buckets_of(placed)).join(placed.select("key"), "key", "left_semi").select("key", "owner")

    def claim(self, batch: DataFrame, number: int, place: Column | str = "owner", stream: str = STREAM) -> DataFrame:
        """batch (key, owner, ...) with `holder`, who owns the key, and `claimed`, whether this row's owner got it in this very batch.

        Of a batch's rows with the same key the first by `place`, then by owner, claims it. Null keys are claimed by no one.
        """
        rows = batch.withColumn("bucket", self.bucket("key"))
        wanted = buckets_of(rows.filter("key is not null"))
        version = self._committed(rows.filter("key is not null"), wanted, number, place, stream)
        # One row a key: of a key that very many rows have, the batch's side can be split.
        held = self.table.read(version, wanted).select(F.col("key").alias("held"), F.col("owner").alias("holder"), ((F.col("stream") == stream) & (F.col("batch") == number)).alias("now"))
        found = rows.join(held, F.col("key") == F.col("held"), "left")
        return found.withColumn("claimed", F.coalesce(F.col("now") & (F.col("holder") == F.col("owner")), F.lit(False))).drop("held", "now", "bucket")

    def _committed(self, rows: DataFrame, wanted: list[tuple], number: int, place: Column | str, stream: str) -> Version:
        base = self.table.version()
        if base.batches.get(stream, -1) >= number:
            return base
        first = rows.groupBy("key", "bucket").agg(F.min_by("owner", F.struct(F.col(place) if isinstance(place, str) else place, F.col("owner"))).alias("owner"))
        new = first.join(self.table.read(base, wanted).select("key"), "key", "left_anti")
        new = new.select("key", "owner", F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"), "bucket").repartition("bucket")
        return self.table.commit(base, self.table.stage(new), batch=(stream, number), reads=wanted)

    def step(self, then: Callable[[DataFrame, int], None], place: str = "owner", stream: str = STREAM) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: claim a batch's keys, then do `then` with the answers. `then` must be repeatable: it sees a batch again if it fails."""

        def run(batch: DataFrame, number: int) -> None:
            then(self.claim(batch, number, place, stream), number)
            if number % MOST_PARTS == MOST_PARTS - 1:
                self.table.compact()

        return run
