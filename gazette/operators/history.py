"""Revision histories: timelines, states at a time, and what is wrong with a chain. Tables have a row for each revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal changes in a row from which on they are a run.
RUN = 3


def exploded(objects: DataFrame, ident: str = "id") -> DataFrame:
    """A row for each revision of objects' array `revisions`."""
    return objects.select(ident, F.explode("revisions").alias("r")).select(ident, "r.*")


def timeline(revisions: DataFrame, ident: str = "id") -> DataFrame:
    return revisions.orderBy(ident, "revision")


def at_revision(revisions: DataFrame, number: int) -> DataFrame:
    """Each object as of that revision; objects without it are not there, never an earlier one in its place."""
    return revisions.filter(F.col("revision") == number)


def as_of(revisions: DataFrame, day: Column, snapshot: str, ident: str = "id", date: str = "date") -> DataFrame:
    """(id, revision, snapshot): the last revision of each object up to a day."""
    last = revisions.filter(F.col(date) <= day).groupBy(ident).agg(F.max_by(snapshot, "revision").alias(snapshot), F.max("revision").alias("revision"))
    return last.select(ident, "revision", snapshot)


def chain_problems(revisions: DataFrame, heads: DataFrame, ident: str = "id") -> DataFrame:
    """(id, problem, revision) of revisions (id, revision, date, changed_fields, content_hash) and heads (id, content_hash).

    numbering: numbers are not 1 to n (at n). initial-changes: revision 1 lists changes. backwards-date: dated before its
    predecessor. no-changes: a later revision lists none. head-mismatch: the object's hash is not its last revision's.
    no-revisions: an object has none (revision null).
    """
    order = Window.partitionBy(ident).orderBy("revision")
    rows = revisions.withColumns({"before": F.lag("date").over(order), "place": F.row_number().over(order)})
    listed = F.size(F.coalesce("changed_fields", F.array().cast("array<string>")))
    found = lambda rows, what: rows.select(ident, F.lit(what).alias("problem"), "revision")
    numbers = rows.groupBy(ident).agg(F.max(F.col("revision") != F.col("place")).alias("off"), F.max("place").alias("revision"))
    last = revisions.groupBy(ident).agg(F.max_by("content_hash", "revision").alias("hash"), F.max("revision").alias("revision"))
    head = last.join(heads.select(ident, F.col("content_hash").alias("own")), ident).filter("hash is not null and not (own <=> hash)")
    none = heads.join(revisions.select(ident), ident, "left_anti").withColumn("revision", F.lit(None).cast("int"))
    return (
        found(numbers.filter("off"), "numbering")
        .unionByName(found(rows.filter((F.col("place") == 1) & (F.col("revision") == 1) & (listed > 0)), "initial-changes"))
        .unionByName(found(rows.filter("date < before"), "backwards-date"))
        .unionByName(found(rows.filter((F.col("place") > 1) & (listed == 0)), "no-changes"))
        .unionByName(found(head, "head-mismatch"))
        .unionByName(found(none, "no-revisions"))
    )


def repeated_runs(revisions: DataFrame, fields: str = "changed_fields", ident: str = "id", least: int = RUN, first: int = 2) -> DataFrame:
    """(id, fields, first_revision, last_revision, length): every run of `least` or more revisions in a row, from the `first` on, with the same changes.

    fields: a sorted array or a string. Revisions after a run lengthen it or leave it, but never hide it.
    """
    order = Window.partitionBy(ident).orderBy("revision")
    rows = revisions.filter(F.col("revision") >= first).withColumn("new", ~F.col(fields).eqNullSafe(F.lag(fields).over(order)) | (F.row_number().over(order) == 1))
    rows = rows.withColumn("island", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(ident, "island").agg(F.first(fields).alias("fields"), F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= least).drop("island")


def retitled(revisions: DataFrame, title: str = "title_snapshot", ident: str = "id") -> DataFrame:
    """(id, previous, current): of each object, the titles before and at its last revision, where they differ."""
    order = Window.partitionBy(ident).orderBy("revision")
    back = Window.partitionBy(ident).orderBy(F.desc("revision"))
    rows = revisions.withColumns({"previous": F.lag(title).over(order), "turn": F.row_number().over(back)})
    return rows.filter(F.col("turn") == 1).filter("previous is not null").filter(~F.col("previous").eqNullSafe(F.col(title))).select(ident, "previous", F.col(title).alias("current"))


def duplicate_writes(revisions: DataFrame, ident: str = "id") -> DataFrame:
    """(id, run_id, writes): runs that wrote an object more than once; revisions without a run are not of one."""
    return revisions.filter("run_id is not null").groupBy(ident, "run_id").agg(F.count("*").alias("writes")).filter("writes > 1")


def changes_since(events: DataFrame, since: Column, by: str = "event_type", ts: str = "ts") -> DataFrame:
    return events.filter(F.col(ts) >= since).groupBy(by).agg(F.count("*").alias("changes"))


def changes_compared(events: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column], by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts by kind in two spans of time, start inclusive, end exclusive."""
    inside = lambda span: ((F.col(ts) >= span[0]) & (F.col(ts) < span[1])).cast("int")
    both = events.groupBy(by).agg(F.sum(inside(first)).alias("first_count"), F.sum(inside(second)).alias("second_count"))
    return both.withColumn("change", F.col("second_count") - F.col("first_count"))


def changes_before(events: DataFrame, of: str, kind: str, by: str = "event_type", ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """(of, first_at, earlier): how many events of each object came before its first of a kind, and when that was."""
    order = F.struct(ts, ident)
    first = events.filter(F.col(by) == kind).groupBy(of).agg(F.min(order).alias("first"))
    met = events.join(first, of).withColumn("before", order < F.col("first"))
    return met.groupBy(of).agg(F.first(F.col(f"first.{ts}")).alias("first_at"), F.sum(F.col("before").cast("int")).alias("earlier"))
