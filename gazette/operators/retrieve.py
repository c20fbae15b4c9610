"""Filtered, ranked retrieval."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


@dataclass(frozen=True)
class Query:
    """Filters that must all hold; None is no filter."""

    text: str | None = None
    tier: int | None = None
    learning_priority: str | None = None
    difficulty: str | None = None
    learning_status: str | None = None
    status: str | None = None
    category: str | None = None
    tag: str | None = None
    source: str | None = None
    since: date | None = None
    until: date | None = None
    needs_review: bool | None = None
    stale: bool | None = None


def effective_date() -> Column:
    return F.coalesce("published_date", "discovered_date")


def stale_artifacts(generation: Column, current: Column) -> Column:
    """Kinds of artifacts that were made from an earlier revision than the current."""
    old = lambda x: x["value"]["status"].isin("generated", "stale") & (x["value"]["generated_from_revision"] < current)
    return F.array_sort(F.transform(F.filter(F.map_entries(generation), old), lambda x: x["key"]))


def current_revision(revisions: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(revisions, lambda r: r["revision"])), F.lit(0))


def _insensitive(column: str, wanted: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))) == wanted.lower()


#: The filters, by field of Query. A new field needs an entry here.
PREDICATES = {
    "text": lambda v: F.contains(fold(F.concat_ws(" ", "title", "category", F.array_join("tags", " "))), fold(F.lit(v))),
    "tier": lambda v: F.col("tier") == v,
    "learning_priority": lambda v: F.col("learning_priority") == v,
    "difficulty": lambda v: F.col("difficulty") == v,
    "learning_status": lambda v: F.col("learning_status") == v,
    "status": lambda v: F.col("status") == v,
    "category": lambda v: _insensitive("category", v),
    "tag": lambda v: F.exists("tags", lambda t: F.lower(t) == v.lower()),
    "source": lambda v: _insensitive("source_name", v),
    "since": lambda v: effective_date() >= F.lit(v),
    "until": lambda v: effective_date() <= F.lit(v),
    "needs_review": lambda v: F.col("needs_review") == v,
    "stale": lambda v: (F.size(stale_artifacts(F.col("generation"), current_revision(F.col("revisions")))) > 0) == v,
}


def condition(query: Query) -> Column:
    wanted = {f.name: getattr(query, f.name) for f in fields(query)}
    return reduce(and_, [PREDICATES[k](v) for k, v in wanted.items() if v is not None], F.lit(True))


def ranking() -> list[Column]:
    return [F.col("tier").asc(), effective_date().desc(), F.col("id").asc()]


def search(objects: DataFrame, query: Query, limit: int | None = None) -> DataFrame:
    """The objects that match, by tier, newest first, then identifier; the first `limit` of them, all where it is None or 0."""
    found = objects.filter(condition(query)).orderBy(*ranking())
    return found.limit(limit) if limit else found


def resolve_id(ids: DataFrame, objects: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, pack, found): the pack of each wanted id; that whose prefix the id has is asked first, then the others in order of name."""
    held = ids.join(objects.select("id", "pack"), "id", "left").join(packs.select("pack", "prefix"), "pack", "left")
    here = F.struct((F.substring_index("id", "-", 1) != F.col("prefix")).alias("other"), "pack")
    best = held.groupBy("id").agg(F.min(F.when(F.col("pack").isNotNull(), here)).alias("best"))
    return best.select("id", F.col("best.pack").alias("pack"), F.col("best").isNotNull().alias("found"))
