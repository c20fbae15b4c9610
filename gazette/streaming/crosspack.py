"""Groups of one thing in several collections, kept up batch by batch.

`members` is a log of which object has which key; the last entry of a key and object counts. `classes` has a row for each key that a batch
has touched: how many sides and collections it has, its first identifier, and two marks, the exclusive or of its members' and of its
collections' hashes. A batch reads and adds to the buckets of its own keys, and no row grows with a group: members are rows.

A group that someone has acknowledged stays so by a rule: with `packs`, as long as it spans the same collections, so that one more
object in a collection that had it already reopens nothing; with `members`, as long as it has the same objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Table, bucket, buckets_of

MEMBERS = "basis string, key string, pack string, id string, present boolean, batch long, bucket int"
CLASSES = "basis string, key string, sides long, packs long, first_id string, member_mark long, pack_mark long, batch long, bucket int"
ACKNOWLEDGED = "basis string, key string, member_mark long, pack_mark long, acknowledged_on date"
#: The mark that an acknowledgement goes by, by rule.
RULES = {"packs": "pack_mark", "members": "member_mark"}
#: In which order bases are listed: a later one leaves out groups of the same objects.
BASES = ("url", "content")


def sides_of(objects: DataFrame, keys: dict[str, str], present: bool = True) -> DataFrame:
    """(basis, key, pack, id, present) of objects (pack, id): a row for each basis whose column, by keys, is not null."""
    each = F.array(*[F.struct(F.lit(b).alias("basis"), F.col(c).alias("key")) for b, c in keys.items()])
    rows = objects.select("pack", F.col("id").cast("string").alias("id"), F.explode(each).alias("s"))
    return rows.select("s.basis", "s.key", "pack", "id", F.lit(present).alias("present")).filter("key is not null")


class CrossPack:
    """Groups under `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, rule: str = "packs"):
        self.mark, self.buckets = RULES[rule], buckets
        self.members = Table(spark, f"{path}/members", MEMBERS, ("bucket",))
        self.classes = Table(spark, f"{path}/classes", CLASSES, ("bucket",))
        self.known = Table(spark, f"{path}/acknowledged", ACKNOWLEDGED)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket(F.concat_ws(":", "basis", "key"), self.buckets))

    def apply(self, changes: DataFrame, number: int) -> None:
        """Take a batch of changes (basis, key, pack, id, present). An object that moves from one key to another is a row for each. A batch that has been taken is not taken again."""
        batch = ("main", number)
        rows = self._placed(changes.filter("key is not null")).withColumn("batch", F.lit(number).cast("long"))
        dealt = lambda df: df.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4)))
        if self.members.version().batches.get("main", -1) < number:
            one = rows.groupBy("basis", "key", "id", "bucket", "batch").agg(F.max("present").alias("present"), F.min("pack").alias("pack"))
            self.members.append(dealt(one), batch=batch)
        if self.classes.version().batches.get("main", -1) < number:
            wanted = buckets_of(rows)
            touched = self.members.read(only=wanted).filter(F.col("batch") == number).select("basis", "key").distinct()
            self.classes.append(dealt(self._counted(self.current(wanted).join(touched, ["basis", "key"], "left_semi"), touched, number)), batch=batch)

    def current(self, only: list[tuple] | None = None) -> DataFrame:
        """(basis, key, pack, id, bucket): the members as they are."""
        last = F.max_by(F.struct("present", "pack"), "batch").alias("m")
        rows = self.members.read(only=only).groupBy("basis", "key", "id", "bucket").agg(last)
        return rows.filter("m.present").select("basis", "key", "m.pack", "id", "bucket")

    def _counted(self, members: DataFrame, touched: DataFrame, number: int) -> DataFrame:
        """Class rows of touched keys; a key whose members have all left has no sides. Counts by collection come first, so that no task has all members of a key."""
        by_pack = members.groupBy("basis", "key", "pack").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.bit_xor(F.xxhash64("id")).alias("m"))
        found = by_pack.groupBy("basis", "key").agg(
            F.sum("n").alias("sides"), F.count("*").alias("packs"), F.min("first_id").alias("first_id"), F.bit_xor("m").alias("member_mark"), F.bit_xor(F.xxhash64("pack")).alias("pack_mark")
        )
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sides", "packs", "member_mark", "pack_mark")}
        return self._placed(touched.join(found, ["basis", "key"], "left").withColumns(zero).withColumn("batch", F.lit(number).cast("long")))

    def groups(self, among: list[tuple] | None = None) -> DataFrame:
        """(basis, key, sides, packs, first_id, member_mark, pack_mark) of the keys that two collections or more have.

        Of two groups of the same objects by different bases the one of the later basis is left out; objects are the same where their
        number, first identifier and mark of 64 bits are.
        """
        columns = ("sides", "packs", "first_id", "member_mark", "pack_mark")
        last = self.classes.read(only=among).groupBy("basis", "key").agg(F.max_by(F.struct(*columns), "batch").alias("c"))
        rows = last.select("basis", "key", "c.*").filter("packs > 1")
        order = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in BASES]), F.col("basis")), F.lit(0))
        same = Window.partitionBy("sides", "first_id", "member_mark")  # as many rows as an object set has bases
        return rows.withColumn("first", order == F.min(order).over(same)).filter("first").drop("first")

    def sides(self, groups: DataFrame) -> DataFrame:
        """(basis, key, pack, id): the members of groups."""
        return self.current().join(groups.select("basis", "key"), ["basis", "key"], "left_semi").select("basis", "key", "pack", "id")

    def acknowledge(self, keys: DataFrame, day: Column) -> None:
        """Acknowledge the groups named in keys (basis, key), as they are now. One that is acknowledged as it is keeps its day."""
        named = self.groups().join(keys.select("basis", "key").distinct(), ["basis", "key"], "left_semi")
        new = named.join(self.known.read().select("basis", "key", self.mark), ["basis", "key", self.mark], "left_anti")
        rest = self.known.read().join(new.select("basis", "key"), ["basis", "key"], "left_anti")
        self.known.overwrite(rest.unionByName(new.select("basis", "key", "member_mark", "pack_mark", day.cast("date").alias("acknowledged_on"))))

    def outstanding(self) -> DataFrame:
        """The groups that no one has acknowledged as they are, by the rule."""
        return self.groups().join(self.known.read().select("basis", "key", self.mark), ["basis", "key", self.mark], "left_anti")
