"""Artifacts that people make of objects: what there is, and what is out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("none", "requested", "generated", "stale", "rejected")


def is_stale(status: Column, made_from: Column, current: Column) -> Column:
    return status.isin("generated", "stale") & (made_from < current)


def artifact_rows(objects: DataFrame, current: Column, ident: str = "id") -> DataFrame:
    """(id, kind, status, made_from, current, behind) for each entry of objects' map `generation`."""
    rows = objects.select(ident, current.alias("current"), F.explode("generation").alias("kind", "g"))
    rows = rows.select(ident, "kind", F.col("g.status").alias("status"), F.col("g.generated_from_revision").alias("made_from"), "current")
    return rows.withColumn("behind", F.when(is_stale(F.col("status"), F.col("made_from"), F.col("current")), F.col("current") - F.col("made_from")))


def by_type(rows: DataFrame) -> DataFrame:
    """A row for each kind of artifact, a column for each status."""
    counts = [F.sum((F.col("status") == s).cast("int")).alias(s) for s in STATUSES]
    return rows.groupBy("kind").agg(*counts)


def refreshed(generation: Column, current: Column) -> Column:
    """The map with `stale` where an artifact was made from an earlier revision, and `generated` where it no longer is."""

    def one(_, g: Column) -> Column:
        status = F.when(is_stale(g["status"], g["generated_from_revision"], current), "stale").when(g["status"] == "stale", "generated").otherwise(g["status"])
        return g.withField("status", status)

    return F.transform_values(generation, one)


def attached(generation: Column, kind: str, path: Column, revision: Column, day: Column) -> Column:
    """The map with an artifact of this kind made at a revision; one that is current already is replaced."""
    entry = F.struct(F.lit("generated").alias("status"), path.alias("path"), day.alias("generated_at"), revision.alias("generated_from_revision"))
    others = F.map_filter(generation, lambda k, _: k != kind)
    return F.map_concat(others, F.create_map(F.lit(kind), entry))


def with_artifact(rows: DataFrame, ident: str = "id") -> DataFrame:
    """(objects): how many objects of artifact_rows() have an artifact that was made."""
    return rows.filter(F.col("status").isin("generated", "stale")).agg(F.count_distinct(ident).alias("objects"))


def requested(generation: Column, kind: str) -> Column:
    """The map with a request for an artifact of this kind, where there is none or it was rejected; any other stays."""
    now = generation[kind]["status"]
    open_ = now.isNull() | now.isin("none", "rejected")
    entry = F.struct(F.lit("requested").alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("generated_at", "date"), ("generated_from_revision", "int"))])
    return F.when(open_, F.map_concat(F.map_filter(generation, lambda k, _: k != kind), F.create_map(F.lit(kind), entry))).otherwise(generation)


def may_attach(generation: Column, kind: str, revision: Column, force: bool) -> Column:
    """Whether an artifact of this kind may be attached: not over one that is current, but by force."""
    now = generation[kind]
    current = (now["status"] == "generated") & (now["generated_from_revision"] >= revision)
    return F.lit(force) | ~F.coalesce(current, F.lit(False))
