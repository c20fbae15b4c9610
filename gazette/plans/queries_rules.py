"""Queries over rules and decisions: places of identifiers, locks, artifacts, review tasks by their providers, queue decisions, filters by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crosspack, retrieve, review, validate
from ..schema import OBJECT_COLUMNS, PROPOSED
from .queries_items import _ALL_GROUPS, _page_objects
from .registry import query, table
from .views import OBJECTS, objects

_PLACED = f"{OBJECTS}, p AS (SELECT id, CASE WHEN pack = 'fr' THEN 'DOX' ELSE 'DOC' END AS prefix, strftime(discovered_date, '%Y/%m') AS month, CASE WHEN status = 'replaced' THEN 'x' || id ELSE id END AS name FROM objects)"


@query(
    f"""WITH {_PLACED} SELECT 'error' AS level, 'OBJ001' AS code, month || '/' || name AS location, 'holds ' || id AS message FROM p WHERE name <> id
UNION ALL SELECT 'error', 'ID002', id, 'the prefix here is DOX' FROM p WHERE prefix = 'DOX'
UNION ALL SELECT 'error', 'ID004', id, 'is under ' || month FROM p WHERE replace(substr(id, 5, 7), '-', '/') <> month"""
)
def place_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects as if they lay under the month of their discovery, replaced ones under another name, those of one collection with another prefix."""
    o = objects(spark, sf_dir)
    name = F.when(F.col("status") == "replaced", F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    path = F.concat_ws("/", F.date_format("discovered_date", "yyyy/MM"), name)
    return validate.identifiers(o.select("id", F.when(F.col("pack") == "fr", "DOX").otherwise("DOC").alias("prefix"), path.alias("path")))


@query(
    f"""WITH {OBJECTS} SELECT 'error' AS level, 'OWN001' AS code, id AS location, 'cannot be locked: notes' AS message FROM objects WHERE needs_review
UNION ALL SELECT 'error', 'OWN002', id, 'no such field: ' || source_name FROM objects WHERE status = 'replaced' AND source_name IS NOT NULL"""
)
def lock_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    locks = F.array_compact(F.array(F.lit("tier"), F.when(F.col("needs_review"), F.lit("notes")), F.when(F.col("status") == "replaced", F.col("source_name"))))
    return validate.overrides(o.select("id", locks.alias("overrides")), list(PROPOSED), list(OBJECT_COLUMNS))


_MADE = f"{OBJECTS}, g AS (SELECT id, needs_review, CASE tier WHEN 1 THEN NULL WHEN 2 THEN 'notes/../' || id ELSE 'artifacts/' || id || '.md' END AS path FROM objects)"


@query(
    f"""WITH {_MADE} SELECT 'error' AS level, 'GEN001' AS code, id AS location, 'no path for quiz' AS message FROM g WHERE path IS NULL
UNION ALL SELECT 'error', 'GEN002', id, 'outside the artifact folders: ' || path FROM g WHERE path LIKE 'notes%'
UNION ALL SELECT 'error', 'GEN003', id, 'no such file: ' || path FROM g WHERE path LIKE 'artifacts%' AND needs_review"""
)
def artifact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of all objects: one tier without a path, one outside of its folders, and files for those that have been reviewed."""
    o = objects(spark, sf_dir)
    path = F.when(F.col("tier") == 2, F.concat(F.lit("notes/../"), "id")).when(F.col("tier") == 3, F.concat(F.lit("artifacts/"), "id", F.lit(".md")))
    made = o.select("id", F.create_map(F.lit("quiz"), F.struct(F.lit("generated").alias("status"), path.alias("path"))).alias("generation"))
    files = o.filter("not needs_review and tier = 3").select("id", path.alias("path"))
    return validate.artifacts(made, files)


_TASKS = f"""{_ALL_GROUPS}, {OBJECTS}, t AS (
  SELECT o_orderkey::VARCHAR AS key, 'queued' AS kind, o_orderpriority AS title, o_orderstatus AS reason FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT id, CASE WHEN status = 'replaced' THEN 'revision' ELSE 'unclassified' END, title, CASE WHEN status = 'replaced' THEN 'New title' ELSE 'no rule matched' END FROM objects WHERE needs_review
  UNION ALL SELECT key, 'cross-pack', ids, 'same ' || basis FROM g WHERE sides <> 2)"""


@query(f"WITH {_TASKS} SELECT key, kind, title, reason, CASE kind WHEN 'queued' THEN 0 WHEN 'cross-pack' THEN 1 WHEN 'revision' THEN 2 ELSE 3 END AS urgency FROM t")
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a person, by the library's own providers: open orders as the queue, documents as objects, pages across hosts."""
    orders = table(spark, sf_dir, "orders")
    lifecycle = F.when(F.col("o_orderstatus") == "O", "queued").otherwise("approved")
    queue = orders.select(F.col("o_orderkey").cast("string").alias("identity_key"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("reason"), F.col("o_orderdate").cast("date").alias("first_seen"), lifecycle.alias("lifecycle"))
    first = F.struct(F.lit("First seen").alias("summary"))
    revisions = F.when(F.col("status") == "replaced", F.array(first, F.struct(F.lit("New title").alias("summary")))).otherwise(F.array(first))
    groups = crosspack.duplicate_groups(_page_objects(spark, sf_dir))
    found = review.tasks([review.queued(queue), review.flagged(objects(spark, sf_dir).withColumn("revisions", revisions)), review.shared(crosspack.outstanding(groups, groups.filter("sides = 2")))])
    return found.select("key", "kind", "title", "reason", "urgency")


_QUEUE = "q AS (SELECT o_orderkey::VARCHAR AS identity_key, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'approved' ELSE 'archived' END AS lifecycle, CASE WHEN o_orderpriority LIKE '1%' THEN 'approved' WHEN o_orderpriority LIKE '2%' THEN 'archived' WHEN o_orderpriority LIKE '3%' THEN 'minted' END AS wanted FROM orders)"
_ACTED = f"""{_QUEUE}, a AS (SELECT identity_key, wanted, lifecycle AS before, CASE WHEN (lifecycle = 'queued' AND wanted IN ('approved', 'archived')) OR (lifecycle = 'approved' AND wanted IN ('minted', 'archived')) THEN wanted ELSE lifecycle END AS lifecycle FROM q)"""


@query(f"WITH {_ACTED} SELECT identity_key, lifecycle FROM a WHERE NOT (lifecycle = 'archived' AND wanted IS NULL)")
def queue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lifecycle after what its priority asks for, as far as that is allowed, and without the archived ones that no one asked about, which are forgotten."""
    o = table(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    lifecycle = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "approved").otherwise("archived")
    wanted = F.when(kind == "1", "approved").when(kind == "2", "archived").when(kind == "3", "minted")
    rows = o.select(F.col("o_orderkey").cast("string").alias("identity_key"), lifecycle.alias("lifecycle"), wanted.alias("wanted"))
    actions = rows.filter("wanted is not null").select("identity_key", F.col("wanted").alias("lifecycle"))
    after = review.act(rows.select("identity_key", "lifecycle"), actions)
    return review.forget(after, rows.filter("wanted is null").select("identity_key")).select("identity_key", "lifecycle")


_FIELDS = f"{OBJECTS}, f AS (SELECT id, CASE tier WHEN 1 THEN 'high' ELSE 'low' END AS learning_priority, lang AS difficulty, CASE WHEN needs_review THEN 'not-started' ELSE 'done' END AS learning_status, source_name, tags, rank % 4 AS behind FROM objects JOIN items USING (rank, title, summary))"


@query(f"WITH {_FIELDS} SELECT id FROM f WHERE learning_priority = 'high' AND difficulty = 'en' AND learning_status = 'not-started' AND behind > 1")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by learning priority, difficulty, learning status and stale artifacts, all at once."""
    o = objects(spark, sf_dir)
    behind = (F.col("rank") % 4).cast("int")
    generation = F.create_map(F.lit("quiz"), F.struct(F.lit("generated").alias("status"), F.lit(1).alias("generated_from_revision")))
    fields = {
        "learning_priority": F.when(F.col("tier") == 1, "high").otherwise("low"), "difficulty": F.col("category"), "learning_status": F.when(F.col("needs_review"), "not-started").otherwise("done"),
        "generation": generation, "revisions": F.array(F.struct(behind.alias("revision"))),
    }
    wanted = retrieve.Query(learning_priority="high", difficulty="en", learning_status="not-started", stale=True)
    return o.withColumns(fields).filter(retrieve.condition(wanted)).select("id")


@query(f"WITH {_ALL_GROUPS}, mine AS (SELECT min(pack) AS pack FROM po JOIN g ON g.key = po.url_hash) SELECT basis, key, sides FROM g WHERE EXISTS (SELECT 1 FROM po, mine WHERE po.pack = mine.pack AND g.key = CASE basis WHEN 'url' THEN url_hash ELSE content_hash END)")
def crosspack_involving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the first host with any is part of."""
    o = _page_objects(spark, sf_dir)
    groups = crosspack.duplicate_groups(o)
    mine = o.join(groups.select(F.col("key").alias("url_hash")), "url_hash", "left_semi").agg(F.min("pack")).first()[0]
    return crosspack.involving(groups, o, mine, {"url": "url_hash", "content": "content_hash"}).select("basis", "key", "sides")
