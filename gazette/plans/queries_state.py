"""Queries over state that is kept between runs: versions of the store, seen keys, identifiers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import automaton
from ..sources.snapshots import Table
from ..streaming.crosspack import CrossPack, sides_of
from ..streaming.health import snapshot, source_health, state_store
from ..streaming.minting import Minter
from ..streaming.seen import SeenIndex
from . import registry as r
from .queries_items import _ALL_GROUPS, _HAY, _MINT, _TAGS, RULES, _first_sql, _hay, _orders_items, _page_objects
from .queries_store import FOLDED
from .registry import query, table
from .shared import shared_dir, written
from .text_index import TextIndex
from .title_index import TitleIndex
from .views import ATTEMPTS, ITEMS, OBJECTS, attempts, items, objects


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gazette/{tag}-{uuid.uuid4().hex}"


_STORED = f"{OBJECTS}, base AS (SELECT id, title, status, pack, substr(id, 10, 2)::INT AS id_month FROM objects), more AS (SELECT 'PAG-' || page_id AS id, url AS title, 'active' AS status, 'pages' AS pack, 1 AS id_month FROM pages)"


@query(
    f"""WITH {_STORED} SELECT 1 AS version, id, title, status FROM base
UNION ALL SELECT 2, id, title, CASE WHEN id_month = 3 THEN 'deprecated' ELSE status END FROM base
UNION ALL SELECT 3, id, title, CASE WHEN id_month = 3 THEN 'deprecated' ELSE status END FROM base UNION ALL SELECT 3, id, title, status FROM more"""
)
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of three versions of a store, read after the last has been committed: all objects; March's changed; the pages added."""
    stored = Table(spark, new_folder(spark, "store"), "id string, title string, status string, pack string, id_month int", ("pack", "id_month"))
    month = F.substring("id", 10, 2).cast("int").alias("id_month")
    stored.append(objects(spark, sf_dir).select("id", "title", "status", "pack", month))
    march = [v for v in stored.version().values() if v[1] == 3]
    stored.merge(march, lambda rows: rows.withColumn("status", F.lit("deprecated")))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("PAG-"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("title"), F.lit("active").alias("status"), F.lit("pages").alias("pack"), F.lit(1).alias("id_month"))
    stored.append(pages)
    each = [stored.read(stored.version(n)).select(F.lit(n).alias("version"), "id", "title", "status") for n in (1, 2, 3)]
    return reduce(DataFrame.unionByName, each)


_CLAIMS = f"{ITEMS}, k AS (SELECT rank, coalesce(lang, '') AS lang, {r.digest(r.line('title || chr(10) || summary'))} AS key FROM items)"


@query(f"WITH {_CLAIMS} SELECT rank AS doc_id, first_value(rank) OVER w AS holder, first_value(rank) OVER w = rank AS claimed FROM k WINDOW w AS (PARTITION BY key ORDER BY lang, rank)")
def seen_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of all documents claimed in batches, one a language; every batch is played twice, and the second answers are what is returned."""
    i = items(spark, sf_dir)
    rows = i.select(F.col("rank").alias("owner"), tx.content_hash(F.col("title"), F.col("summary")).alias("key"), F.coalesce("lang", F.lit("")).alias("lang")).withColumn("place", F.col("owner")).withColumn("owner", F.col("owner").cast("string"))
    index = SeenIndex(spark, new_folder(spark, "seen"), buckets=16)
    langs = [x[0] for x in rows.select("lang").distinct().orderBy("lang").collect()]
    for number, lang in enumerate(langs):
        index.claim(rows.filter(F.col("lang") == lang), number, "place")
    again = [index.claim(rows.filter(F.col("lang") == lang), number, "place") for number, lang in enumerate(langs)]
    return reduce(DataFrame.unionByName, again).select(F.col("place").alias("doc_id"), F.col("holder").cast("long").alias("holder"), "claimed")


_BATCHES = _MINT[: _MINT.index("n AS (SELECT")] + "n AS (SELECT *, row_number() OVER (PARTITION BY month_key ORDER BY key, published NULLS LAST, lpad(o_orderkey::VARCHAR, 12, '0')) AS sequence FROM m)"


@query(f"WITH {_BATCHES} SELECT o_orderkey, 'ORD-' || month_key || '-' || lpad(sequence::VARCHAR, greatest(3, length(sequence::VARCHAR))::INT, '0') AS id FROM n")
def mint_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all orders, given out in batches, one a priority, and asked for once more as one batch."""
    rows, _ = _orders_items(spark, sf_dir)
    rows = rows.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    minter = Minter(spark, new_folder(spark, "minter"), buckets=16)
    kinds = [x[0] for x in rows.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    for number, kind in enumerate(kinds):
        minter.mint(rows.filter(F.col("o_orderpriority") == kind), number)
    return minter.mint(rows, len(kinds)).select("o_orderkey", "id")


_TITLE_SETS = f"""{ITEMS}, t AS (SELECT rank, list_distinct(list_filter(string_split({r.norm_title('title')}, ' '), lambda w: w <> '')) AS w FROM items),
sets AS (SELECT list_sort(w) AS w, min(rank) AS owner FROM t WHERE len(w) > 0 GROUP BY 1),
scored AS (SELECT t.rank AS doc_id, owner, len(list_intersect(t.w, sets.w)) AS c, len(t.w) + len(sets.w) AS n FROM t, sets WHERE t.rank % 100 = 0)"""


@query(f"WITH {_TITLE_SETS} SELECT doc_id, owner, round(c / (n - c), 9) AS similarity FROM scored WHERE c / (n - c) >= 0.85")
def title_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document's title against an index of all titles, added in two batches, one of which is tried twice."""
    titles = items(spark, sf_dir).select("rank", F.col("rank").cast("string").alias("owner"), tx.title_tokens(F.col("title")).alias("tokens"))
    index = TitleIndex(spark, new_folder(spark, "titles"), 0.85, buckets=16)
    index.freeze(titles)
    middle = titles.agg(F.percentile_approx("rank", 0.5)).first()[0] or 0
    for number, half in ((0, titles.filter(F.col("rank") <= middle)), (1, titles.filter(F.col("rank") > middle)), (1, titles)):
        index.add(half, number, "rank")
    found = index.probe(titles.filter("rank % 100 = 0"), "rank")
    return found.select(F.col("rank").alias("doc_id"), F.col("owner").cast("long").alias("owner"), F.round("similarity", 9).alias("similarity"))


@query(f"WITH {OBJECTS} SELECT id FROM objects WHERE contains({FOLDED}, 'and the')")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_text by postings of trigrams."""
    o = objects(spark, sf_dir)
    hay = F.concat_ws(" ", "title", "category", F.array_join("tags", " "))
    index = TextIndex(spark, new_folder(spark, "grams"), buckets=16)
    index.add(o.select("id", hay.alias("text")), 0)
    return index.search(o, "And, THE", hay).select("id")


@query(
    f"WITH {_HAY} SELECT rank AS doc_id, {_first_sql('tier', 'value')} AS tier, {_first_sql('tier', 'name')} AS tier_by, {_first_sql('category', 'value')} AS category, {_first_sql('category', 'name')} AS category_by, "
    f"array_to_string(list_sort(list_filter({_TAGS}, lambda x: x IS NOT NULL)), ',') AS tags FROM hay"
)
def classify_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All axes of all documents by one automaton."""
    found = automaton.classified(_hay(spark, sf_dir), "h", RULES)
    axes = [F.col(f"{a}.{part}").alias(name) for a in ("tier", "category") for part, name in (("value", a), ("matched_by", f"{a}_by"))]
    return found.select("doc_id", *axes, F.array_join("tags", ",").alias("tags"))


_FOLD = f"""{ATTEMPTS}, w AS (SELECT *, list(items) FILTER (ok) OVER before AS earlier, list(items) FILTER (ok) OVER upto AS counted, max(CASE WHEN ok THEN event_id END) OVER upto AS last_ok
  FROM attempts WINDOW before AS (PARTITION BY source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN len(earlier) >= 3 THEN list_aggregate(earlier[-26:], 'median') END AS was, CASE WHEN len(counted) >= 3 THEN list_aggregate(counted[-26:], 'median') END AS baseline,
  count(*) FILTER (NOT ok) OVER (PARTITION BY source, last_ok ORDER BY event_id) AS streak FROM w),
f AS (SELECT *, lag(streak, 1, 0) OVER (PARTITION BY source ORDER BY event_id) AS before FROM m)"""


@query(
    f"""WITH {_FOLD} SELECT source::VARCHAR AS source, event_id AS attempt, CASE WHEN NOT ok THEN 'failed' WHEN NOT is_primary OR coalesce(was > 0 AND items < was * 0.34, false) THEN 'degraded' ELSE 'healthy' END AS state,
streak::INT AS consecutive_failures, round(baseline, 6) AS baseline, streak >= 3 AS needs_alert, CASE WHEN streak = 3 THEN 'opened' WHEN streak = 0 AND before >= 3 THEN 'closed' END AS alert FROM f"""
)
def health_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every source after every attempt, by the stream's own processor over two halves, the second from the first's snapshot."""
    a = attempts(spark, sf_dir).select(F.col("source").cast("string").alias("source"), F.col("event_id").alias("attempt"), "ok", "items", F.col("is_primary").alias("primary"))
    middle = a.agg(F.percentile_approx("attempt", 0.5)).first()[0] or 0
    with state_store(spark):
        first = written(source_health(a.filter(F.col("attempt") <= middle)), "health")
        second = written(source_health(a.filter(F.col("attempt") > middle), snapshot(first)), "health")
    columns = ("source", "attempt", "state", "consecutive_failures", F.round("baseline", 6).alias("baseline"), "needs_alert", "alert")
    return first.unionByName(second).select(*columns)


@query(f"WITH {_ALL_GROUPS}, r AS (SELECT basis, key, sides, packs, (SELECT min(id::VARCHAR) FROM po WHERE g.key = CASE basis WHEN 'url' THEN url_hash ELSE content_hash END) AS first_id FROM g) SELECT * FROM r")
def crosspack_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-pack groups of all pages, kept up over two halves and a batch that comes twice."""
    o = _page_objects(spark, sf_dir)
    kept = CrossPack(spark, new_folder(spark, "crosspack"), buckets=16)
    middle = o.agg(F.percentile_approx("id", 0.5)).first()[0] or 0
    for number, part in ((0, o.filter(F.col("id") <= middle)), (1, o.filter(F.col("id") > middle)), (1, o)):
        kept.apply(sides_of(part, {"url": "url_hash", "content": "content_hash"}), number)
    return kept.groups().select("basis", "key", "sides", "packs", "first_id")
