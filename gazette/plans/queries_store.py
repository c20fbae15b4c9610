"""Queries over what is stored: retrieval, history, integrity, review, coverage, reports, health."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import iso_week
from ..operators import coverage, crosspack, digest, health, history, retrieve, review, validate
from . import registry as r
from .registry import query, table
from .views import ATTEMPTS, ITEMS, LINES, OBJECTS, REVISIONS, attempts, lines, objects, revisions

# --- retrieval

FOLDED = "trim(regexp_replace(lower(title || ' ' || category || ' ' || array_to_string(tags, ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"WITH {OBJECTS} SELECT id FROM objects WHERE contains({FOLDED}, 'and the')")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).filter(retrieve.condition(retrieve.Query(text="And, THE"))).select("id")


@query(f"WITH {OBJECTS} SELECT id, coalesce(published_date, discovered_date) AS effective FROM objects WHERE coalesce(published_date, discovered_date) BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'")
def search_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = retrieve.Query(since=date(2024, 3, 1), until=date(2024, 6, 30))
    return objects(spark, sf_dir).filter(retrieve.condition(q)).select("id", retrieve.effective_date().alias("effective"))


@query(f"WITH {OBJECTS} SELECT id FROM objects WHERE tier = 2 AND lower(category) = 'en' AND list_contains(tags, 'src3') AND lower(source_name) = 'src3' AND needs_review AND status = 'active'")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = retrieve.Query(tier=2, category="EN", tag="Src3", source="SRC3", needs_review=True, status="active")
    return objects(spark, sf_dir).filter(retrieve.condition(q)).select("id")


@query(f"WITH {OBJECTS} SELECT id, tier, coalesce(published_date, discovered_date) AS effective FROM objects WHERE status = 'active' ORDER BY tier, effective DESC, id")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(objects(spark, sf_dir), retrieve.Query(status="active")).select("id", "tier", retrieve.effective_date().alias("effective"))


@query(f"WITH {OBJECTS} SELECT id, tier FROM objects WHERE status = 'active' ORDER BY tier, coalesce(published_date, discovered_date) DESC, id LIMIT 25")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(objects(spark, sf_dir), retrieve.Query(status="active"), 25).select("id", "tier")


@query(f"WITH {OBJECTS}, w AS (SELECT id FROM objects UNION ALL SELECT 'XXX-2024-01-00' || n::VARCHAR FROM range(5) t(n)) SELECT w.id, pack, pack IS NOT NULL AS found FROM w LEFT JOIN objects o ON o.id = w.id")
def id_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).select("id", "pack")
    packs = o.select("pack").distinct().withColumn("prefix", F.lit("DOC"))
    wanted = o.select("id").unionByName(spark.range(5).select(F.concat(F.lit("XXX-2024-01-00"), F.col("id").cast("string")).alias("id")))
    return retrieve.resolve_id(wanted, o, packs)


# --- history


@query(f"WITH {REVISIONS} SELECT id, revision, date, fields FROM revisions ORDER BY id, revision")
def history_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.timeline(revisions(spark, sf_dir)).select("id", "revision", "date", "fields")


@query(f"WITH {REVISIONS} SELECT id, content_hash FROM revisions WHERE revision = 3")
def history_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.at_revision(revisions(spark, sf_dir), 3).select("id", "content_hash")


@query(f"WITH {REVISIONS} SELECT id, max(revision) AS revision, arg_max(content_hash, revision) AS content_hash FROM revisions WHERE date <= DATE '2024-01-20' GROUP BY id")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(revisions(spark, sf_dir), F.lit("2024-01-20").cast("date"), "content_hash")


@query(f"WITH {REVISIONS} SELECT id, max(revision) AS revision FROM revisions GROUP BY id")
def revision_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).groupBy("id").agg(F.max("revision").alias("revision"))


@query(
    f"""WITH {REVISIONS}, heads AS (SELECT id, min_by(content_hash, revision) AS own, max_by(content_hash, revision) AS hash, max(revision) AS revision, count(*) AS n FROM revisions GROUP BY id),
    o AS (SELECT *, lag(date) OVER w AS before, row_number() OVER w AS place FROM revisions WINDOW w AS (PARTITION BY id ORDER BY revision))
    SELECT id, 'head-mismatch' AS problem, revision FROM heads WHERE own <> hash UNION ALL SELECT id, 'backwards-date', revision FROM o WHERE date < before
    UNION ALL SELECT id, 'numbering', max(place)::INT FROM o GROUP BY id HAVING bool_or(place <> revision) UNION ALL SELECT id, 'initial-changes', revision FROM o WHERE place = 1 AND revision = 1 AND has_changes
    UNION ALL SELECT id, 'no-changes', revision FROM o WHERE place > 1 AND NOT has_changes"""
)
def history_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads are first snapshots here, so that most histories disagree with them."""
    rows = revisions(spark, sf_dir)
    return history.chain_problems(rows, rows.groupBy("id").agg(F.min_by("content_hash", "revision").alias("content_hash")))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as its revisions."""
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("n").alias("revision"), F.col("l_linestatus").alias("fields"), F.col("l_returnflag").alias("run_id"), F.col("l_partkey").cast("string").alias("title_snapshot"))


_RUNS = f"""{LINES}, k AS (SELECT l_orderkey AS id, n AS revision, l_linestatus AS fields FROM lines WHERE n >= 2),
s AS (SELECT *, CASE WHEN fields IS NOT DISTINCT FROM lag(fields) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY id ORDER BY revision)),
i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY revision ROWS UNBOUNDED PRECEDING) AS island FROM s),
runs AS (SELECT id, min(fields) AS fields, min(revision) AS first_revision, max(revision) AS last_revision, count(*) AS length FROM i GROUP BY id, island HAVING count(*) >= 3)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def revision_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_runs(_kinds(spark, sf_dir), "fields")


@query(f"WITH {_RUNS}, a AS (SELECT id, fields, first_revision, CASE WHEN id % 3 = 0 THEN last_revision - 1 ELSE last_revision END AS last_revision FROM runs WHERE id % 2 = 0) SELECT CASE WHEN a.id IS NOT NULL THEN 'info' ELSE 'warning' END AS level, 'REV002' AS code, count(*) AS findings FROM runs LEFT JOIN a USING (id, fields, first_revision, last_revision) GROUP BY 1, 2 UNION ALL SELECT 'warning', 'REV003', count(*) FROM a ANTI JOIN runs USING (id, fields, first_revision, last_revision) HAVING count(*) > 0")
def baseline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = history.repeated_runs(_kinds(spark, sf_dir), "fields")
    accepted = runs.filter("id % 2 = 0").withColumn("last_revision", F.when(F.col("id") % 3 == 0, F.col("last_revision") - 1).otherwise(F.col("last_revision")))
    return validate.summary(validate.baseline_match(runs, accepted, ["id", "fields", "first_revision", "last_revision"], F.col("id")))


@query(f"WITH {LINES}, o AS (SELECT l_orderkey AS id, l_partkey::VARCHAR AS t, lag(l_partkey::VARCHAR) OVER w AS previous, lead(l_partkey) OVER w IS NULL AS is_last FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) SELECT id, previous, t AS current FROM o WHERE is_last AND previous <> t")
def revision_retitled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retitled(_kinds(spark, sf_dir))


@query("SELECT l_orderkey AS id, l_returnflag AS run_id, count(*) AS writes FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicate_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicate_writes(_kinds(spark, sf_dir))


@query("SELECT event_type, count(*) AS changes FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes_since(table(spark, sf_dir, "events"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15') AS first_count, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-02-01') AS second_count, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-02-01') - count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15') AS change FROM events GROUP BY 1")
def changes_month_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    return history.changes_compared(table(spark, sf_dir, "events"), (at("2024-01-01"), at("2024-01-15")), (at("2024-01-15"), at("2024-02-01")))


@query("WITH f AS (SELECT user_id, min(struct_pack(t := ts, e := event_id)) AS f FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, f.t AS first_at, count(*) FILTER (struct_pack(t := ts, e := event_id) < f)::BIGINT AS earlier FROM events JOIN f USING (user_id) GROUP BY user_id, f")
def changes_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes_before(table(spark, sf_dir, "events"), "user_id", "error")


# --- integrity


@query("SELECT l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS location, 'ID003' AS code FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k > 1")
def id_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumns({"pair": F.struct("l_orderkey", "l_partkey"), "at": F.concat_ws("/", "l_orderkey", "l_linenumber")})
    from pyspark.sql import Window

    again = line.withColumn("turn", F.row_number().over(Window.partitionBy("pair").orderBy("l_linenumber"))).filter("turn > 1")
    return validate.finding(again, validate.ERROR, "ID003", F.col("at"), F.lit("")).select("location", "code")


@query("SELECT o_orderkey::VARCHAR AS location, 'SCHEMA003' AS code, 'o_orderpriority is ' || o_orderpriority AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def vocabulary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.vocabulary(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH"), "o_orderkey").select("location", "code", "message")


@query("SELECT code, key, count(*) AS documents FROM (SELECT 'SCHEMA002' AS code, 'q' AS key FROM events WHERE NOT list_contains(json_keys(props), 'q') UNION ALL SELECT 'SCHEMA004', unnest(list_filter(json_keys(props), lambda k: k NOT IN ('q'))) FROM events) GROUP BY 1, 2")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.schema_keys(table(spark, sf_dir, "events"), F.json_object_keys("props"), ["q"], F.col("event_id"))
    return found.groupBy("code", F.regexp_extract("message", r"(\S+)$", 1).alias("key")).agg(F.count("*").alias("documents"))


@query(f"WITH {OBJECTS} SELECT id AS location, 'undeclared category ' || category AS message FROM objects WHERE category NOT IN ('en', 'de')")
def undeclared_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("en",), ("de",)], "category string")
    return validate.undeclared_category(objects(spark, sf_dir), declared).select("location", "message")


@query(f"WITH {ITEMS}, w AS (SELECT rank, len({r.words('summary')}) AS n FROM items) SELECT rank::VARCHAR AS location, n::VARCHAR || ' words' AS message FROM w WHERE n > 600")
def summary_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).select(F.col("rank").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("# t\n"), F.regexp_replace("summary", "#", "+")).alias("body"))
    return validate.article(o, 600).filter("code = 'COPY001'").select("location", "message")


@query("SELECT code, count(*) AS findings FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'REG005' WHEN l.k IS NULL THEN 'REG003' WHEN l.path <> o.path THEN 'REG004' END AS code FROM (SELECT o_orderkey, o_orderstatus AS path FROM orders) o FULL JOIN (SELECT l_orderkey AS k, min(l_linestatus) AS path FROM lineitem GROUP BY 1) l ON l.k = o.o_orderkey) WHERE code IS NOT NULL GROUP BY 1")
def registry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("path"))
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("path"))
    return validate.registry(held, known).groupBy("code").agg(F.count("*").alias("findings"))


@query("WITH u AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, max(o_orderkey) AS used, count(*) * 100 AS counter FROM orders GROUP BY 1) SELECT m AS location, 'number ' || used::VARCHAR || ' is in use' AS message FROM u WHERE counter < used")
def registry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month_key"), F.col("o_orderkey").alias("sequence"))
    counters = o.groupBy("month_key").agg((F.count("*") * 100).alias("counter"))
    return validate.registry_counters(o, counters).select("location", "message")


@query("SELECT DISTINCT o_orderkey AS id, 'customer' AS field, o_custkey AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION SELECT l_orderkey, 'parts', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)")
def ref_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("parts"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")).join(parts, "id", "full_outer")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return crosspack.dangling(o, known, ["customer", "parts"])


@query(f"WITH {LINES}, f AS (SELECT l_orderkey AS id, l_partkey AS target, min(n) AS pos FROM lines GROUP BY 1, 2), k AS (SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place FROM f) SELECT id, place::INT AS place, target::VARCHAR AS target, p_name AS title FROM k LEFT JOIN part ON p_partkey = target WHERE place < 3")
def related_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("n", F.col("l_partkey").cast("string").alias("p"))))
    o = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(parts, lambda x: x["p"]).alias("related"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    return crosspack.referenced(o, known, ["related"], 3)


@query(f"WITH {OBJECTS} SELECT level, code, count(*) AS findings FROM (SELECT 'warning' AS level, 'SCHEMA005' AS code FROM objects WHERE category NOT IN ('en', 'de') UNION ALL SELECT 'error', 'SCHEMA003' FROM objects WHERE status <> 'active') GROUP BY 1, 2")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    declared = spark.createDataFrame([("en",), ("de",)], "category string")
    return validate.summary(validate.union([validate.undeclared_category(o, declared), validate.vocabulary(o, "status", ("active",))]))


# --- review


_TASKS = f"""{OBJECTS}, t AS (
  SELECT {r.digest('id')} AS key, 'queued' AS kind, published_date AS first_seen FROM objects WHERE status = 'replaced'
  UNION ALL SELECT {r.digest("'u' || id")}, 'unclassified', discovered_date FROM objects WHERE needs_review
  UNION ALL SELECT {r.digest("'r' || id")}, 'revision', published_date FROM objects WHERE tier = 3)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)

    def provider(rows: DataFrame, kind: str, key, seen: str) -> DataFrame:
        return rows.select(tx.digest(key).alias("key"), F.lit(kind).alias("kind"), "title", F.lit("").alias("reason"), F.col(seen).alias("first_seen"), F.col("id").alias("object_id"))

    return review.tasks(
        [
            provider(o.filter("status = 'replaced'"), "queued", F.col("id"), "published_date"),
            provider(o.filter("needs_review"), "unclassified", F.concat(F.lit("u"), F.col("id")), "discovered_date"),
            provider(o.filter("tier = 3"), "revision", F.concat(F.lit("r"), F.col("id")), "published_date"),
        ]
    )


@query(f"WITH {_TASKS} SELECT kind, CASE kind WHEN 'queued' THEN 0 WHEN 'revision' THEN 2 ELSE 3 END AS urgency, first_seen, substr(key, 8, 12) AS short_key FROM t ORDER BY urgency, first_seen NULLS FIRST, key")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ordered(_tasks(spark, sf_dir)).select("kind", "urgency", "first_seen", "short_key")


@query(f"WITH {_TASKS} SELECT kind, substr(key, 8, 12) AS short_key FROM t ORDER BY CASE kind WHEN 'queued' THEN 0 WHEN 'revision' THEN 2 ELSE 3 END, first_seen NULLS FIRST, key LIMIT 1")
def review_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ordered(_tasks(spark, sf_dir)).limit(1).select("kind", "short_key")


@query(f"WITH {_TASKS} SELECT k.kind, count(t.key) AS tasks FROM (VALUES ('queued'), ('cross-pack'), ('revision'), ('unclassified')) k(kind) LEFT JOIN t USING (kind) GROUP BY 1")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts(_tasks(spark, sf_dir))


# --- coverage

_GENERATION = f"{LINES}, g AS (SELECT l_orderkey AS id, 'kind' || n::VARCHAR AS kind, CASE WHEN l_returnflag = 'R' THEN 'generated' WHEN l_returnflag = 'A' THEN 'requested' ELSE 'stale' END AS status, n AS made_from, 4 AS current FROM lines)"


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as artifacts of their order, which is at revision 4."""
    status = F.when(F.col("l_returnflag") == "R", "generated").when(F.col("l_returnflag") == "A", "requested").otherwise("stale")
    entry = F.struct(F.concat(F.lit("kind"), F.col("n").cast("string")).alias("k"), F.struct(status.alias("status"), F.col("n").alias("generated_from_revision")).alias("v"))
    return lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("generation"))


@query(f"WITH {_GENERATION} SELECT kind, count(*) FILTER (status = 'none') AS \"none\", count(*) FILTER (status = 'requested') AS requested, count(*) FILTER (status = 'generated') AS \"generated\", count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'rejected') AS rejected FROM g GROUP BY 1")
def coverage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_type(coverage.artifact_rows(_artifacts(spark, sf_dir), F.lit(4)))


@query(f"WITH {_GENERATION} SELECT id, kind, current - made_from AS behind FROM g WHERE status IN ('generated', 'stale') AND made_from < current")
def coverage_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.artifact_rows(_artifacts(spark, sf_dir), F.lit(4)).filter("behind is not null").select("id", "kind", "behind")


@query(f"WITH {_GENERATION} SELECT id, kind, CASE WHEN status IN ('generated', 'stale') AND made_from < 3 THEN 'stale' WHEN status = 'stale' THEN 'generated' ELSE status END AS status FROM g")
def artifact_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = _artifacts(spark, sf_dir).withColumn("generation", coverage.refreshed(F.col("generation"), F.lit(3)))
    return after.select("id", F.explode("generation").alias("kind", "g")).select("id", "kind", "g.status")


# --- reports


@query(f"WITH {OBJECTS} SELECT id, title, published_date FROM objects ORDER BY published_date DESC NULLS LAST, id")
def index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.index(objects(spark, sf_dir)).select("id", "title", "published_date")


def _group_sql(by: str) -> str:
    return f"WITH {OBJECTS} SELECT {by} AS \"group\", count(*) AS objects, string_agg(id, ' ' ORDER BY published_date DESC NULLS LAST, id) AS ids FROM objects GROUP BY 1"


@query(_group_sql("source_name"))
def index_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.grouped_index(objects(spark, sf_dir), F.col("source_name"))


@query(_group_sql("coalesce(strftime(published_date, '%Y-%m'), 'undated')"))
def index_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.grouped_index(objects(spark, sf_dir), F.coalesce(F.date_format("published_date", "yyyy-MM"), F.lit("undated")))


@query(f"WITH {OBJECTS} SELECT sha256('Explain.' || chr(10) || chr(10) || '<data>' || chr(10) || '# ' || title || chr(10) || chr(10) || '- Tier: ' || tier::VARCHAR || chr(10) || '- Published: ' || coalesce(published_date::VARCHAR, 'unknown') || chr(10) || chr(10) || {r.truncated('summary', 120)} || chr(10) || chr(10) || 'Related: none' || chr(10) || chr(10) || 'Source: ' || source_name || chr(10) || '</data>' || chr(10)) AS pack_sha256, id FROM objects")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = digest.facts({"Tier": F.col("tier"), "Published": F.col("published_date")})
    made = digest.context_pack("Explain.", F.col("title"), known, tx.truncate_summary(F.col("summary"), 120), F.lit(None).cast("string"), F.col("source_name"))
    return objects(spark, sf_dir).select("id", F.sha2(made, 256).alias("pack_sha256"))


@query(f"WITH {OBJECTS} SELECT pack, strftime(discovered_date, '%G-W%V') AS iso_week, count(*) AS new_objects, count(*) FILTER (needs_review) AS to_review, CASE WHEN count(*) FILTER (needs_review) > 0 THEN count(*) FILTER (needs_review)::VARCHAR || ' problems' ELSE count(*)::VARCHAR || ' new' END AS subject FROM objects GROUP BY 1, 2")
def digest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).groupBy("pack", iso_week(F.col("discovered_date")).alias("iso_week"))
    rows = rows.agg(F.count("*").alias("new_objects"), F.sum(F.col("needs_review").cast("int")).alias("to_review"))
    return rows.withColumn("subject", digest.subject(F.col("to_review"), F.col("new_objects")))


@query(f"WITH {OBJECTS} SELECT o.id, tier FROM objects o WHERE rank IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY tier::VARCHAR, o.id")
def digest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    minted = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("rank"))
    return objects(spark, sf_dir).join(minted, "rank", "left_semi").orderBy(F.col("tier").cast("string"), "id").select("id", "tier")


# --- sources' health


_BASE = """b AS (SELECT source, count(*) AS observations, CASE WHEN count(*) >= 3 THEN median(items) END AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS k FROM {rows} WHERE ok) WHERE k <= 26 GROUP BY 1)"""
_STREAK = """s AS (SELECT source, count(*) FILTER (NOT ok AND (last_ok IS NULL OR struct_pack(t := ts, e := event_id) > last_ok)) AS streak FROM attempts LEFT JOIN (SELECT source, max(struct_pack(t := ts, e := event_id)) AS last_ok FROM attempts WHERE ok GROUP BY 1) USING (source) GROUP BY 1)"""


@query(f"WITH {ATTEMPTS}, {_BASE.format(rows='attempts')} SELECT source, observations, round(baseline, 6) AS baseline FROM b")
def source_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.baseline(attempts(spark, sf_dir), "source", ["ts", "event_id"], F.col("ok"), "items").withColumn("baseline", F.round("baseline", 6))


@query(f"WITH {ATTEMPTS}, {_STREAK} SELECT source, streak::BIGINT AS streak, streak >= 3 AS needs_alert FROM s")
def source_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failure_streak(attempts(spark, sf_dir), "source", ["ts", "event_id"], F.col("ok"))


@query(f"""WITH {ATTEMPTS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS turn FROM attempts), older AS (SELECT * FROM n WHERE turn > 1), {_BASE.format(rows='older')}
SELECT state, count(*) AS sources FROM (SELECT CASE WHEN NOT ok THEN 'failed' WHEN NOT is_primary OR coalesce(baseline > 0 AND items < baseline * 0.34, false) THEN 'degraded' ELSE 'healthy' END AS state FROM n LEFT JOIN b USING (source) WHERE turn = 1) GROUP BY 1""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = health.states(attempts(spark, sf_dir), "source", ["ts", "event_id"], F.col("ok"), "items", F.col("is_primary"))
    return found.groupBy("state").agg(F.count("*").alias("sources"))


@query("SELECT strftime(ts, '%G-W%V') AS iso_week, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def events_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(iso_week(F.col("ts").cast("date")).alias("iso_week"), "event_type").agg(F.count("*").alias("events"))


# --- queues, keys, documents


@query(f"WITH {OBJECTS}, q AS (SELECT CASE WHEN status = 'replaced' THEN 'archived' WHEN needs_review THEN 'queued' ELSE 'minted' END AS lifecycle FROM objects) SELECT k.lifecycle, count(q.lifecycle) AS items FROM (VALUES ('discovered'), ('queued'), ('approved'), ('minted'), ('archived')) k(lifecycle) LEFT JOIN q USING (lifecycle) GROUP BY 1")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("status") == "replaced", "archived").when(F.col("needs_review"), "queued").otherwise("minted")
    return review.queue_counts(objects(spark, sf_dir).select(stage.alias("lifecycle")))


_KEYS = f"{OBJECTS}, k AS (SELECT DISTINCT sha256(id) AS long, substr(sha256(id), 1, 12) AS key FROM objects), p AS (SELECT DISTINCT substr(key, 1, 4) AS prefix FROM k)"


@query(f"WITH {_KEYS} SELECT prefix, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(key) END AS key FROM p JOIN k ON substr(key, 1, 4) = prefix GROUP BY 1")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = objects(spark, sf_dir).select(F.substring(F.sha2("id", 256), 1, 12).alias("short_key"))
    return review.lookup(keys, keys.select(F.substring("short_key", 1, 4).alias("prefix")))


@query("SELECT DISTINCT user_id AS source FROM events WHERE event_type = 'error'")
def sources_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failed_sources(attempts(spark, sf_dir), "source", F.col("ok"))


@query(f"WITH {_GENERATION} SELECT count(DISTINCT id) AS objects FROM g WHERE status IN ('generated', 'stale')")
def objects_with_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.with_artifact(coverage.artifact_rows(_artifacts(spark, sf_dir), F.lit(4)))


@query(f"WITH {OBJECTS} SELECT count(DISTINCT pack) AS packs, count(*) AS objects FROM objects")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.scan_summary(objects(spark, sf_dir))


_LINES = f"""{OBJECTS},
l AS (
  SELECT pack, document, grp, CASE WHEN published_date IS NULL THEN '9' ELSE lpad((10000000 - (published_date - DATE '1970-01-01'))::VARCHAR, 9, '0') END || '/' || id AS place,
         id || ' | ' || coalesce(published_date::VARCHAR, 'undated') || ' | ' || title AS line
  FROM objects, (VALUES ('INDEX'), ('by-source'), ('by-month')) d(document),
       LATERAL (SELECT CASE document WHEN 'INDEX' THEN 'all' WHEN 'by-source' THEN coalesce(source_name, 'unknown') ELSE coalesce(strftime(published_date, '%Y-%m'), 'undated') END AS grp))"""


@query(f"WITH {_LINES} SELECT pack, document, grp AS \"group\", place, line FROM l UNION ALL SELECT pack, document, grp, '', '## ' || grp || ' (' || count(*)::VARCHAR || ')' FROM l GROUP BY pack, document, grp")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.index_lines(objects(spark, sf_dir))


_WEEKS = f"""{OBJECTS}, o AS (SELECT *, strftime(discovered_date, '%G-W%V') AS week FROM objects), r AS (SELECT pack, week, count(*) AS discovered, count(*) FILTER (needs_review) AS queued FROM o GROUP BY 1, 2),
m AS (SELECT * FROM o WHERE NOT needs_review), c AS (SELECT pack, week, count(*) AS minted FROM m GROUP BY 1, 2),
u AS (SELECT pack, week, id AS line, row_number() OVER (PARTITION BY pack, week ORDER BY id) AS turn FROM o WHERE status = 'replaced'),
x AS (SELECT r.*, coalesce(minted, 0) AS minted FROM r LEFT JOIN c USING (pack, week))"""


@query(f"""WITH {_WEEKS}
SELECT pack, week, 0 AS section, '0' AS place, '# ' || pack || ': ' || week AS line FROM x
UNION ALL SELECT pack, week, 0, '1', 'run r' FROM x
UNION ALL SELECT pack, week, 4, '0', '## Summary' FROM x
UNION ALL SELECT pack, week, 4, k, '- ' || n || ': ' || v::VARCHAR FROM x, LATERAL (VALUES ('10', 'discovered', discovered), ('11', 'minted', minted), ('12', 'updated', 0), ('13', 'unchanged', 0), ('14', 'queued', queued), ('15', 'classified', 0)) t(k, n, v)
UNION ALL SELECT pack, week, 5, '0', '## ' || queued::VARCHAR || ' to review' FROM x WHERE queued > 0
UNION ALL SELECT pack, week, 5, '1unclassified', '- unclassified: ' || queued::VARCHAR FROM x WHERE queued > 0
UNION ALL SELECT pack, week, 7, '0', CASE WHEN minted = 0 THEN '## Nothing new: all sources were read' ELSE '## New' END FROM x
UNION ALL SELECT pack, week, 7, '1/' || tier::VARCHAR || '/' || id, id || ' | ' || tier::VARCHAR || ' | ' || substr(title, 1, 70) FROM m
UNION ALL SELECT DISTINCT pack, week, 8, '0', '## Updated' FROM u
UNION ALL SELECT pack, week, 8, '1' || lpad(turn::VARCHAR, 9, '0'), '- ' || line FROM u WHERE turn <= 25
UNION ALL SELECT pack, week, 8, '2', '- and ' || (count(*) - 25)::VARCHAR || ' more' FROM u GROUP BY pack, week HAVING count(*) > 25""")
def digest_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).withColumn("week", iso_week(F.col("discovered_date")))
    queued = F.sum(F.col("needs_review").cast("int"))
    runs = o.groupBy("pack", "week").agg(F.count("*").alias("discovered"), queued.alias("queued"))
    runs = runs.select("*", F.lit("r").alias("run_id"), *[F.lit(0).alias(c) for c in ("updated", "unchanged", "classified")])
    none = o.limit(0).select("pack", "week", F.col("id").alias("line"))
    backlog = runs.select("pack", "week", F.lit("unclassified").alias("kind"), F.col("queued").alias("tasks"))
    artifacts = runs.select("pack", "week", F.lit(0).alias("stale"), F.lit(0).alias("requested"))
    updated = o.filter("status = 'replaced'").select("pack", "week", F.col("id").alias("line"))
    return digest.digest_lines(runs, o.filter("not needs_review"), none, none, none, updated, backlog, artifacts)
