"""Identifiers for batches: one writer reserves ranges of numbers and gives them out in the same commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.minting import mint
from ..sources.snapshots import MOST_PARTS, Table, Version, bucket, buckets_of

SCHEMA = "identity_key string, prefix string, month_key string, sequence long, id string, batch long, bucket int"
COUNTERS = "prefix string, month_key string, counter long"
STREAM = "main"


class Minter:
    """Identifiers by identity key, for good, and the last number of each collection and month.

    The numbers of a batch and the identifiers made of them are one version. What a batch that dies has reserved was never
    committed, a batch that comes again finds its identifiers, and a second writer that has moved the counters meanwhile makes
    this one's commit a Conflict instead of two identifiers with one number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.table = Table(spark, path, SCHEMA, ("bucket",))

    def counters(self, version: Version | None = None) -> DataFrame:
        """(prefix, month_key, counter): a row for each collection and month."""
        notes = (version or self.table.version()).notes.get("counters", [])
        return self.spark.createDataFrame([tuple(r) for r in notes], COUNTERS)

    def mint(self, batch: DataFrame, number: int, stream: str = STREAM) -> DataFrame:
        """batch (prefix, published_date, first_seen, identity_key, ...) with id: that which its key has, else the next of its month.

        A key that comes more than once in a batch counts with its earliest date. Null keys have no identifier.
        """
        rows = batch.withColumn("bucket", bucket("identity_key", self.buckets))
        keyed = rows.filter("identity_key is not null")
        wanted = buckets_of(keyed)
        version = self._committed(keyed, wanted, number, stream)
        made = self.table.read(version, wanted).select(F.col("identity_key").alias("made"), "id")
        return rows.join(made, F.col("identity_key") == F.col("made"), "left").drop("made", "bucket")

    def _committed(self, rows: DataFrame, wanted: list[tuple], number: int, stream: str) -> Version:
        base = self.table.version()
        if base.batches.get(stream, -1) >= number:
            return base
        first = F.min(F.struct(F.coalesce("published_date", F.lit("9999-12-31").cast("date")).alias("day"), "published_date", "first_seen", "prefix")).alias("f")
        new = rows.join(self.table.read(base, wanted).select("identity_key"), "identity_key", "left_anti").groupBy("identity_key", "bucket").agg(first)
        minted = mint(new.select("identity_key", "bucket", "f.published_date", "f.first_seen", "f.prefix"), self.counters(base))
        parts = self.table.stage(minted.withColumn("batch", F.lit(number).cast("long")).repartition("bucket"))
        # What has been staged is counted, not what is to be: the counters are those of the files.
        staged = self.table.read(Version(parts=tuple(parts)))
        last = {(p, m): n for p, m, n in base.notes.get("counters", [])}
        last |= {(r.prefix, r.month_key): r.counter for r in staged.groupBy("prefix", "month_key").agg(F.max("sequence").alias("counter")).collect()}  # a row a month
        return self.table.commit(base, parts, batch=(stream, number), notes={"counters": [[*k, n] for k, n in sorted(last.items())]}, reads=True)

    def step(self, then: Callable[[DataFrame, int], None], stream: str = STREAM) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: give a batch's items identifiers, then do `then` with them. `then` must be repeatable."""

        def run(batch: DataFrame, number: int) -> None:
            then(self.mint(batch, number, stream), number)
            if number % MOST_PARTS == MOST_PARTS - 1:
                self.table.compact()

        return run
