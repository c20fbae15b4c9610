"""What waits for a person: a queue of unminted items, and one view over everything that needs a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_key

#: What is looked at first.
URGENCY = {"queued": 0, "cross-pack": 1, "revision": 2, "unclassified": 3}
#: Where an item may go from where it is.
TRANSITIONS = {"discovered": ("queued", "approved"), "queued": ("approved", "archived"), "approved": ("minted", "archived"), "minted": ("archived",), "archived": ()}
COLUMNS = ("key", "kind", "title", "reason", "first_seen", "object_id")


def valid_transition(old: Column, new: Column) -> Column:
    """Whether an item may go from old to new; staying is allowed."""
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            allowed = allowed | ((old == source) & new.isin(*targets))
    return (old == new) | allowed


def enqueue(items: DataFrame, queue: DataFrame, key: str = "identity_key") -> DataFrame:
    """The items that the queue has no entry for: entries keep the day they were first seen."""
    return items.join(queue.select(key), key, "left_anti")


def tasks(providers: list[DataFrame]) -> DataFrame:
    """One view of what all providers (COLUMNS) find, with urgency and the key that a person types."""
    rows = providers[0].select(*COLUMNS)
    for p in providers[1:]:
        rows = rows.unionByName(p.select(*COLUMNS))
    urgency = F.lit(99)
    for kind, n in URGENCY.items():
        urgency = F.when(F.col("kind") == kind, n).otherwise(urgency)
    return rows.withColumns({"urgency": urgency, "short_key": short_key(F.col("key"))})


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("urgency", F.col("first_seen").asc_nulls_first(), "key")


def counts(found: DataFrame) -> DataFrame:
    """(kind, tasks) for every kind, zeros included."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in URGENCY], "kind string")
    return kinds.join(found.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("tasks"))


def act(queue: DataFrame, actions: DataFrame, key: str = "identity_key") -> DataFrame:
    """queue with `lifecycle` as actions (key, lifecycle) want it, where that is a valid transition."""
    wanted = actions.groupBy(key).agg(F.max("lifecycle").alias("wanted"))
    rows = queue.join(wanted, key, "left")
    moved = F.col("wanted").isNotNull() & valid_transition(F.col("lifecycle"), F.col("wanted"))
    return rows.withColumn("lifecycle", F.when(moved, F.col("wanted")).otherwise(F.col("lifecycle"))).drop("wanted")


def queue_counts(queue: DataFrame) -> DataFrame:
    """(lifecycle, items) for every lifecycle, zeros included."""
    stages = queue.sparkSession.createDataFrame([(k,) for k in TRANSITIONS], "lifecycle string")
    return stages.join(queue.groupBy("lifecycle").agg(F.count("*").alias("n")), "lifecycle", "left").select("lifecycle", F.coalesce("n", F.lit(0)).alias("items"))


def lookup(rows: DataFrame, prefixes: DataFrame, key: str = "short_key", most: int = 12) -> DataFrame:
    """(prefix, matches, key) for what people typed (prefix): how many keys begin so, and the key where it is the only one.

    Keys are spread over their beginnings, as many as a short key has characters, so that the join is by equality.
    """
    begins = rows.select(F.col(key).alias("key")).distinct().select("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(most))), lambda n: F.col("key").substr(F.lit(1), n))).alias("prefix"))
    found = prefixes.select("prefix").distinct().join(begins, "prefix", "left").groupBy("prefix").agg(F.count("key").alias("matches"), F.min("key").alias("least"))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("least")).alias("key"))


def queued(queue: DataFrame) -> DataFrame:
    """Items that wait to be minted."""
    return queue.filter("lifecycle = 'queued'").select(F.col("identity_key").alias("key"), F.lit("queued").alias("kind"), "title", "reason", "first_seen", F.lit(None).cast("string").alias("object_id"))


def flagged(objects: DataFrame) -> DataFrame:
    """Stored objects that need review: `revision` where they have changed since they were minted, else `unclassified`."""
    changed = F.size("revisions") > 1
    kind, reason = F.when(changed, "revision").otherwise("unclassified"), F.when(changed, F.element_at("revisions", -1)["summary"]).otherwise("no rule matched")
    return objects.filter("needs_review").select(F.col("id").alias("key"), kind.alias("kind"), "title", reason.alias("reason"), F.col("discovered_date").alias("first_seen"), F.col("id").alias("object_id"))


def shared(groups: DataFrame) -> DataFrame:
    """Groups of objects in several packs (basis, key, ids) that no one has acknowledged."""
    return groups.select(F.col("key").alias("key"), F.lit("cross-pack").alias("kind"), F.col("ids").alias("title"), F.concat(F.lit("same "), "basis").alias("reason"), F.lit(None).cast("date").alias("first_seen"), F.lit(None).cast("string").alias("object_id"))


#: What can be done with a task of each kind.
ACTIONS = {"queued": ("approve", "archive"), "cross-pack": ("resolve",), "revision": ("resolve",), "unclassified": ("resolve",)}


def dispatch(found: DataFrame, actions: DataFrame) -> DataFrame:
    """tasks() with `action` as actions (short_key, action) want it; a short key of `*` stands for all. Actions that a task's kind does not have are refused: `refused` is true."""
    each = actions.filter("short_key <> '*'").groupBy("short_key").agg(F.max("action").alias("one"))
    every = actions.filter("short_key = '*'").agg(F.max("action")).first()[0]
    rows = found.join(each, "short_key", "left").withColumn("action", F.coalesce("one", F.lit(every).cast("string"))).filter("action is not null").drop("one")
    able = F.lit(False)
    for kind, names in ACTIONS.items():
        able = able | ((F.col("kind") == kind) & F.col("action").isin(*names))
    return rows.withColumn("refused", ~able)


def applied(chosen: DataFrame, queue: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queue, objects and newly acknowledged keys (key) after what dispatch() chose: queued items move, flagged objects need no review any more, and groups are acknowledged without a change to their objects."""
    done = chosen.filter(~F.col("refused"))
    moves = done.filter("kind = 'queued'").select(F.col("key").alias("identity_key"), F.when(F.col("action") == "approve", "approved").otherwise("archived").alias("lifecycle"))
    seen = done.filter(F.col("object_id").isNotNull()).select(F.col("object_id").alias("id")).distinct().withColumn("reviewed", F.lit(True))
    objects = objects.join(seen, "id", "left").withColumn("needs_review", F.col("needs_review") & F.col("reviewed").isNull()).drop("reviewed")
    return act(queue, moves), objects, done.filter("kind = 'cross-pack'").select("key").distinct()


def forget(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """queue without archived items of keys (identity_key), which may be discovered anew; others stay."""
    gone = keys.select("identity_key").distinct().withColumn("gone", F.lit(True))
    return queue.join(gone, "identity_key", "left").filter(F.col("gone").isNull() | (F.col("lifecycle") != "archived")).drop("gone")
