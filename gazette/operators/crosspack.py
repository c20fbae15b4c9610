"""One thing in several collections, and references that lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_groups(objects: DataFrame, basis: str, key: str, pack: str = "pack", ident: str = "id") -> DataFrame:
    """(basis, key, ids, packs, sides) of keys that two packs or more have; ids are sorted and joined with a plus sign."""
    groups = objects.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(ident).cast("string"))), "+").alias("ids"), F.count_distinct(pack).alias("packs"), F.count("*").alias("sides")
    )
    return groups.filter("packs > 1").select(F.lit(basis).alias("basis"), "key", "ids", "packs", "sides")


def duplicate_groups(objects: DataFrame, **names: str) -> DataFrame:
    """Groups by url_hash, then those by content_hash that are not the same objects over again."""
    by_url = shared_groups(objects, "url", "url_hash", **names)
    by_content = shared_groups(objects, "content", "content_hash", **names)
    return by_url.unionByName(by_content.join(by_url.select("ids"), "ids", "left_anti").select(*by_url.columns))


def outstanding(groups: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Groups that no one has acknowledged (ids)."""
    return groups.join(acknowledged.select("ids").distinct(), "ids", "left_anti")


def dangling(objects: DataFrame, known: DataFrame, fields: list[str], ident: str = "id") -> DataFrame:
    """(id, field, target) of references, scalar or array, to an id that `known` lacks; distinct."""
    rows = None
    for f in fields:
        array = objects.schema[f].dataType.typeName() == "array"
        target = F.explode(f) if array else F.col(f)
        one = objects.select(ident, F.lit(f).alias("field"), target.alias("target")).filter("target is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct().join(known.select(F.col(ident).alias("target")), "target", "left_anti").select(ident, "field", "target")


def referenced(objects: DataFrame, known: DataFrame, fields: list[str], most: int = 8, ident: str = "id", title: str = "title") -> DataFrame:
    """(id, place, target, title): what each object refers to, in order of the fields and within them, each target once, the first `most`."""
    together = F.array_distinct(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in fields])))
    rows = objects.select(ident, F.posexplode(together).alias("place", "target")).filter(F.col("place") < most)
    return rows.join(known.select(F.col(ident).alias("target"), F.col(title).alias("title")), "target", "left").select(ident, "place", "target", "title")


def ordered(groups: DataFrame) -> DataFrame:
    """Groups by basis, then by their identifiers."""
    return groups.orderBy("basis", "ids")


def acknowledge(groups: DataFrame, known: DataFrame, keys: DataFrame, day: Column) -> DataFrame:
    """known (ids, basis, acknowledged_on) with the groups named in keys (key); one that is known keeps its day. No object changes."""
    new = groups.join(keys.select("key").distinct(), "key", "left_semi").join(known.select("ids"), "ids", "left_anti")
    return known.select("ids", "basis", "acknowledged_on").unionByName(new.select("ids", "basis", day.cast("date").alias("acknowledged_on")))


def involving(groups: DataFrame, objects: DataFrame, pack: str, basis_keys: dict[str, str]) -> DataFrame:
    """The groups that an object of `pack` is part of; basis_keys names the column of objects that each basis goes by."""
    of_pack = objects.filter(F.col("pack") == pack)
    mine = None
    for basis, column in basis_keys.items():
        one = of_pack.filter(F.col(column).isNotNull()).select(F.lit(basis).alias("basis"), F.col(column).alias("key")).distinct()
        mine = one if mine is None else mine.unionByName(one)
    return groups.join(mine, ["basis", "key"], "left_semi")


def evidence(groups: DataFrame, objects: DataFrame, basis_keys: dict[str, str], shown: list[str]) -> DataFrame:
    """(basis, key, pack, id, facts): every side of every group, a row each, with what a person needs to tell the sides apart."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in shown])
    rows = None
    for basis, column in basis_keys.items():
        sides = objects.select(F.col(column).alias("key"), "pack", F.col("id").cast("string").alias("id"), lines.alias("facts"))
        one = groups.filter(F.col("basis") == basis).select("basis", "key").join(sides, "key").select("basis", "key", "pack", "id", "facts")
        rows = one if rows is None else rows.unionByName(one)
    return rows
