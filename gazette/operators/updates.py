"""Changes to stored objects: what differs, which sighting wins, revisions, and who may write what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a stored object that a new sighting may change; a difference in the last alone is not worth a revision.
COMPARED = ("announcement_url", "content_hash", "date_confidence", "date_precision", "identity_confidence", "published_date", "source_url", "title", "url_hash")
IMMATERIAL = ("identity_confidence",)


def changed_fields(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names, sorted, of (name, stored, seen) that differ; null equals null."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~old.eqNullSafe(new), F.lit(name)) for name, old, new in pairs])))


def is_material(fields: Column) -> Column:
    return F.size(F.array_except(fields, F.array(*[F.lit(x) for x in IMMATERIAL]))) > 0


def describe(fields: Column) -> Column:
    """A sentence on what moved."""
    has = lambda name: F.array_contains(fields, name)
    return (
        F.when(has("title") & has("content_hash"), "New title and new summary")
        .when(has("title"), "New title")
        .when(has("content_hash"), "New summary")
        .when(has("published_date"), "Publication date corrected")
        .when(has("source_url") | has("url_hash"), "Moved to a new URL")
        .otherwise(F.concat(F.lit("Changed: "), F.array_join(fields, ", ")))
    )


def update_winner(sightings: DataFrame, object_col: str, key_col: str) -> DataFrame:
    """One sighting of each object: that of the least identity key."""
    turn = Window.partitionBy(object_col).orderBy(key_col)
    return sightings.withColumn("turn", F.row_number().over(turn)).filter("turn = 1").drop("turn")


def append_revision(objects: DataFrame, revisions: str, fields: str, made: dict[str, Column]) -> DataFrame:
    """objects whose array `revisions` has one more where the change in `fields` is material; it has the next number, and `made` names its other fields."""
    kind = objects.schema[revisions].dataType.elementType
    own = {"revision": F.size(revisions) + 1, "changed_fields": F.col(fields)} | made
    entry = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    return objects.withColumn(revisions, F.when(is_material(F.col(fields)), F.concat(revisions, F.array(entry))).otherwise(F.col(revisions)))


class OwnershipError(ValueError):
    pass


def guard_ownership(before: DataFrame, after: DataFrame, key: str, user_owned: list[str], proposed: list[str] | None = None, locks: str = "overrides") -> DataFrame:
    """after, or OwnershipError where a column that users own differs from before, or one of `proposed` that `locks` of the stored row names."""
    met = before.alias("b").join(after.alias("a"), key)
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in user_owned]
    same += [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) | ~F.coalesce(F.array_contains(f"b.{locks}", c), F.lit(False)) for c in proposed or ()]
    broken = met.filter(~F.array_min(F.array(*same))).select(key).limit(1).collect()
    if broken:
        raise OwnershipError(f"a column that users own or have locked would change, of {broken[0][0]} for one")
    return after


def merge(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """stored with the rows of changed in place of its own of the same key, and those it lacks."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)


def supersede(objects: DataFrame, pairs: DataFrame, day: Column | None = None) -> DataFrame:
    """objects (id, status, replaced_by, replaces, ...) after pairs (old_id, new_id): the old is replaced, the new says by whom.

    Where objects have `revisions`, the old one gains a revision of this day, with its title, summary and hash as they were.

    Pairs of an object with itself are ignored, as are those whose old object is replaced already or whose ends are not
    both there; of several for one old object, that of the least new_id counts.
    """
    ids = objects.select(F.col("id").alias("there"), "replaced_by")
    usable = pairs.filter("old_id <> new_id").join(ids, F.col("old_id") == F.col("there")).filter("replaced_by is null").select("old_id", "new_id")
    usable = usable.join(objects.select(F.col("id").alias("new_there")), F.col("new_id") == F.col("new_there"), "left_semi")
    usable = usable.groupBy("old_id").agg(F.min("new_id").alias("by"))
    of_new = usable.groupBy(F.col("by").alias("id")).agg(F.min("old_id").alias("of"))
    met = objects.join(usable.withColumnRenamed("old_id", "id"), "id", "left").join(of_new, "id", "left")
    met = met.withColumns({"status": F.when(F.col("by").isNotNull(), "replaced").otherwise(F.col("status")), "replaced_by": F.coalesce("by", "replaced_by"), "replaces": F.coalesce("of", "replaces")})
    if "revisions" in objects.columns:
        kind = objects.schema["revisions"].dataType.elementType
        last = F.element_at("revisions", -1) if "summary_snapshot" in kind.names else None
        own = {
            "revision": F.size("revisions") + 1, "date": day, "changed_fields": F.array(F.lit("replaced_by"), F.lit("status")), "summary": F.concat(F.lit("Replaced by "), "by"),
            "content_hash": F.col("content_hash") if "content_hash" in objects.columns else None, "title_snapshot": F.col("title") if "title" in objects.columns else None,
            "summary_snapshot": None if last is None else last["summary_snapshot"],
        }
        entry = F.struct(*[(F.lit(None) if own.get(f.name) is None else own[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
        met = met.withColumn("revisions", F.when(F.col("by").isNotNull(), F.concat("revisions", F.array(entry))).otherwise(F.col("revisions")))
    return met.drop("by", "of")
