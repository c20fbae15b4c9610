"""One run over what sources delivered: deduplicate, update what is stored, gate and mint what is new, classify, store.

Updates come before minting, objects before the states that name them, so a run that breaks off can be run again. A
second run over the same items changes nothing but the run log. Rules are proposed to all stored objects of the pack, and
set only fields that nothing has set yet. An item that makes no valid object is counted under `errors` and stays queued if
it was; the others are minted.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import parse_id
from ..functions.urls import url_hash
from ..operators import classify, dedupe, identity, minting, review, updates
from ..schema import OBJECT_COLUMNS, SCHEMA_VERSION
from ..sources import store
from ..sources.registry import Registry
from .shared import written
from .weekly import digest_of_run, write_digest

QUEUE = "identity_key string, title string, source_name string, reason string, first_seen date, lifecycle string"
#: What a proposed field is before rules or people set it.
DEFAULTS = {"tier": 3, "learning_priority": "low", "difficulty": "intermediate", "workload": "light"}


@dataclass(frozen=True)
class Run:
    """A run's identity and clock; nothing here asks the machine what time it is."""

    pack: str
    prefix: str
    run_id: str
    now: datetime
    threshold: float = 0.85
    official: tuple[str, ...] = ("official",)

    @property
    def today(self) -> date:
        return self.now.date()


def harvest(spark: SparkSession, root: str, run: Run, items: DataFrame, rules: dict[str, list[classify.Rule]], attempts: DataFrame | None = None) -> dict[str, int]:
    """Take items (of sources.discover) into the store under root and write the digest of the week; what happened, in numbers. attempts: those of discover(), for the digest."""
    path, queue_path = f"{root}/objects", f"{root}/queue/{run.pack}"
    stored = store.read_objects(spark, path).filter(F.col("pack") == run.pack)
    queue = store.read_state(spark, queue_path, QUEUE)
    items = _prepared(items, run)
    decisions = _decided(items, stored, run)

    changed = written(_updated(decisions, stored, run), "harvest-updates")
    n_updated = changed.count() if store.update_objects(changed.drop("changed"), path) else 0
    stored = store.read_objects(spark, path).filter(F.col("pack") == run.pack)  # with what has been updated

    new = decisions.filter(F.col("verdict").isin(dedupe.NEW, dedupe.NEAR))
    minted, waiting = _gated(new, queue, run)
    registry = Registry(spark, root)
    made = written(_objects(minted, stored, registry.counters().filter(F.col("pack") == run.pack), rules, run), "harvest-new")
    objects = made.filter(_sound())
    n_made, n_new = made.count(), objects.count()
    if n_new:
        registry.record(objects, run.run_id)
        store.insert_objects(objects, path)
    stored = store.read_objects(spark, path).filter(F.col("pack") == run.pack)
    placed = written(_classified(stored, rules), "harvest-classified")
    n_placed = placed.count() if store.update_objects(placed, path) else 0
    queue_after = written(_queued(queue, waiting, objects, run), "harvest-queue")
    store.write_state(queue_after, queue_path, "identity_key")

    report = {"items": decisions.count(), "minted": n_new, "updated": n_updated, "classified": n_placed, "errors": n_made - n_new, "queued": queue_after.filter("lifecycle = 'queued'").count()}
    report |= {f"verdict_{r.verdict}": r["items"] for r in dedupe.tally(decisions).collect()}
    store.append_run_log(spark, f"{root}/run-log", {"pack": run.pack, "run": run.run_id, "at": run.now.isoformat()} | report)
    stored = store.read_objects(spark, path).filter(F.col("pack") == run.pack)
    write_digest(digest_of_run(run, report, stored, objects, changed, decisions, queue_after, attempts), root)
    return report


def _prepared(items: DataFrame, run: Run) -> DataFrame:
    """Items in their order, graded."""
    items = items.filter("identity is not null").withColumns(
        {"identity_key": F.col("identity.key"), "identity_basis": F.col("identity.basis"), "content_hash": tx.content_hash(F.col("title"), F.col("summary")), "url_hash": url_hash(F.col("source_url"))}
    )
    graded = identity.gate(identity.grade(items), official=run.official)
    # Ranks increase from partition to partition of the sorted items; they are not dense, and no task has all items.
    ordered = graded.orderBy(*minting.item_order(), "title", "summary")
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()), "harvest-items")


def _decided(items: DataFrame, stored: DataFrame, run: Run) -> DataFrame:
    known = stored.select("id", F.col("provenance.identity_key").alias("key"), F.element_at("revisions", 1).alias("r"))
    owner = F.min("id").alias("owner")
    keys = known.groupBy("key").agg(owner)
    contents = known.groupBy(F.col("r.content_hash").alias("content")).agg(owner)
    titles = known.groupBy(tx.normalise_title(F.col("r.title_snapshot")).alias("title")).agg(owner).filter("title <> ''")
    keyed = items.select("rank", F.col("identity_key").alias("key"), F.col("content_hash").alias("content"), tx.title_tokens(F.col("title")).alias("tokens"))
    verdicts = dedupe.decide(keyed, run.threshold, seen_titles=titles, seen_keys=keys, seen_contents=contents)
    return written(items.join(verdicts, "rank"), "harvest-decisions")


def _revision(number: Column, fields: Column, said: Column, run: Run) -> Column:
    return F.struct(
        number.cast("int").alias("revision"), F.lit(run.today).alias("date"), fields.alias("changed_fields"), said.alias("summary"),
        F.col("content_hash").alias("content_hash"), F.col("title").alias("title_snapshot"), F.col("summary").alias("summary_snapshot"), F.lit(run.run_id).alias("run_id"),
    )


def _updated(decisions: DataFrame, stored: DataFrame, run: Run) -> DataFrame:
    """Stored objects that a sighting under their own identity changes; of several sightings, that of the least key counts."""
    sightings = decisions.filter((F.col("verdict") == dedupe.KNOWN_IDENTITY) & (F.col("matched") != dedupe.PENDING))
    seen = updates.update_winner(sightings, "matched", "identity_key").alias("i")
    met = stored.alias("o").join(seen, F.col("o.id") == F.col("i.matched"))
    fields = updates.changed_fields([(c, F.col(f"o.{c}"), F.col(f"i.{c}")) for c in updates.COMPARED])
    met = met.withColumn("changed", fields).filter(F.size("changed") > 0)
    made = {"date": F.lit(run.today), "summary": updates.describe(F.col("changed")), "content_hash": F.col("i.content_hash"), "title_snapshot": F.col("i.title"), "summary_snapshot": F.col("i.summary"), "run_id": F.lit(run.run_id)}
    met = updates.append_revision(met.withColumn("own_revisions", F.col("o.revisions")), "own_revisions", "changed", made)
    values = {c: F.col(f"i.{c}") if c in updates.COMPARED else F.col(f"o.{c}") for c in OBJECT_COLUMNS} | {"revisions": F.col("own_revisions")}
    return met.select(*[v.cast(OBJECT_COLUMNS[c]).alias(c) for c, v in values.items()], F.col("o.pack").alias("pack"), "changed")


def _gated(new: DataFrame, queue: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """New items to mint, with the day they were first seen, and those that wait. A person's approval overrides the gate."""
    entries = queue.select("identity_key", F.col("lifecycle").alias("decided"), "first_seen")
    met = new.join(entries, "identity_key", "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(run.today)))
    passes = (F.col("lifecycle") == "approved") | F.coalesce(F.col("decided") == "approved", F.lit(False))
    return met.filter(passes), met.filter(~passes)


def _sound() -> Column:
    """Whether a row can be stored: an identifier of the right form, and a title with a slug."""
    return F.coalesce(parse_id(F.col("id")).isNotNull() & (F.trim("title") != "") & (F.col("slug") != ""), F.lit(False))


def _proposed(hay: Column, rules: dict[str, list[classify.Rule]]) -> dict[str, Column]:
    """What the rules say for each axis, as text; a tier that is no number is none."""
    found = {axis: classify.first_match(hay, rules.get(axis, []), axis)["value"] for axis in classify.AXES}
    return found | {"tier": found["tier"].try_cast("int").cast("string")}


def _classified(stored: DataFrame, rules: dict[str, list[classify.Rule]]) -> DataFrame:
    """Stored objects that the rules change, changed: unset and unlocked fields, reading time, and a flag on those that no rule places."""
    summary = F.coalesce(F.get("revisions", F.size("revisions") - 1)["summary_snapshot"], F.col("title"))
    hay = classify.haystack(F.col("title"), F.col("slug"), summary)
    axes, tags = _proposed(hay, rules), classify.all_matches(hay, rules.get("tags", []))
    locked = lambda c: F.coalesce(F.array_contains("overrides", c), F.lit(False))
    now = {axis: classify.applicable(F.col(axis), F.lit(DEFAULTS.get(axis)).cast(OBJECT_COLUMNS[axis]), v.cast(OBJECT_COLUMNS[axis]), locked(axis)) for axis, v in axes.items()}
    now["tags"] = classify.applicable(F.col("tags"), F.array().cast("array<string>"), F.when(F.size(tags) > 0, tags), locked("tags"))
    now["version"] = classify.applicable(F.col("version"), F.lit("").cast("string"), tx.release_wave(hay), locked("version"))
    now["reading_time"] = F.when(locked("reading_time"), F.col("reading_time")).otherwise(tx.reading_time(F.concat_ws(" ", "title", summary)).cast("int"))
    now["needs_review"] = F.coalesce(F.col("needs_review"), F.lit(False)) | classify.needs_review(axes["tier"], axes["category"])
    moved = F.lit(False)
    for c, v in now.items():
        moved = moved | ~F.col(c).eqNullSafe(v)
    return stored.filter(moved).withColumns(now)


def _objects(minted: DataFrame, stored: DataFrame, registered: DataFrame, rules: dict[str, list[classify.Rule]], run: Run) -> DataFrame:
    parsed = stored.select(parse_id(F.col("id")).alias("p")).select(F.lit(run.prefix).alias("prefix"), "p.month_key", "p.sequence")
    exact_day = F.when(F.col("date_confidence") == "exact", F.col("published_date"))
    # Numbers go on from the highest that is stored or has ever been recorded.
    used = parsed.unionByName(registered.select(F.lit(run.prefix).alias("prefix"), "month_key", F.col("counter").alias("sequence")))
    rows = minting.mint(minted.withColumns({"prefix": F.lit(run.prefix), "dated": exact_day}), minting.counters_after(used), published="dated")
    hay = classify.haystack(F.col("title"), tx.slugify(F.col("title")), F.col("summary"))
    proposed = _proposed(hay, rules)
    values = {c: F.lit(None) for c in OBJECT_COLUMNS} | {c: F.col(c) for c in rows.columns if c in OBJECT_COLUMNS}
    provenance = F.struct(
        "source_name", F.lit(None).cast("string").alias("source_representation"), F.lit(None).cast("string").alias("adapter_type"), F.lit(1).alias("parser_version"), "extraction_method",
        "identity_basis", "identity_key", F.lit(run.now).cast("timestamp").alias("discovered_at"), F.lit("primary").alias("source_role"), "selector", F.lit(run.run_id).alias("run_id"),
    )
    none = F.array().cast("array<string>")
    values |= {
        "schema_version": F.lit(SCHEMA_VERSION),
        "slug": tx.slugify(F.col("title")),
        "discovered_date": F.col("first_seen"),
        "provenance": provenance,
        "tags": classify.all_matches(hay, rules.get("tags", [])),
        "version": tx.release_wave(hay),
        "reading_time": tx.reading_time(F.concat_ws(" ", "title", "summary")),
        "learning_status": F.lit("not-started"),
        "lifecycle": F.lit("minted"),
        "status": F.lit("active"),
        "needs_review": classify.needs_review(proposed["tier"], proposed["category"]) | (F.col("verdict") == dedupe.NEAR),
        "revisions": F.array(_revision(F.lit(1), none, F.lit("First seen"), run)),
        **{c: none for c in ("prerequisites", "builds_on", "related_topics", "overrides")},
        **{axis: F.coalesce(v, F.lit(DEFAULTS.get(axis)).cast("string")) for axis, v in proposed.items()},
    }
    return rows.select(*[v.cast(OBJECT_COLUMNS[c]).alias(c) for c, v in values.items()], F.lit(run.pack).alias("pack"))


def _queued(queue: DataFrame, waiting: DataFrame, objects: DataFrame, run: Run) -> DataFrame:
    """The queue without what has been minted, and with what waits now; entries keep their first day."""
    fresh = review.enqueue(waiting, queue).dropDuplicates(["identity_key"])
    fresh = fresh.select("identity_key", "title", "source_name", F.col("confidence_reason").alias("reason"), F.lit(run.today).alias("first_seen"), F.lit("queued").alias("lifecycle"))
    minted = objects.select(F.col("provenance.identity_key").alias("identity_key"))
    return queue.unionByName(fresh).join(minted, "identity_key", "left_anti")
