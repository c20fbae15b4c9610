"""Queries over items: identity, deduplication, gate, minting, updates, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import classify, crosspack, dedupe, identity, minting, review, updates, validate
from . import registry as r
from .registry import query, table
from .views import ITEMS, OBJECTS, items, objects, page_items

# --- identity


@query(f"WITH {ITEMS}, n AS (SELECT rank, {r.norm_title('title')} AS t, {r.line("title || ' ' || summary")} AS s FROM items) SELECT rank AS doc_id, CASE WHEN t <> '' THEN 'normalised-title-hash' ELSE 'content-fingerprint' END AS basis, CASE WHEN t <> '' THEN {r.digest('t')} ELSE {r.digest('s')} END AS key FROM n WHERE t <> '' OR s <> ''")
def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    found = items(spark, sf_dir).select(F.col("rank").alias("doc_id"), identity.resolve(none, none, F.col("title"), F.col("summary")).alias("i"))
    return found.filter("i is not null").select("doc_id", "i.basis", "i.key")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as items whose announcement is the page's site and first folder, so that some share one."""
    key = urls.canonical_url(F.regexp_extract("url", "^([^?#]*?/)[^/?#]*/?(?:[?#].*)?$", 1))
    p = page_items(spark, sf_dir).select("rank", "url", "pack", key.alias("announcement"))
    basis = F.when(F.col("rank") % 11 == 0, "content-fingerprint").when(F.col("rank") % 7 == 0, "normalised-title-hash").otherwise("canonical-url")
    return p.select("rank", "pack", tx.digest(F.col("announcement")).alias("identity_key"), basis.alias("identity_basis"), F.col("url").alias("title"), F.when(F.col("rank") % 3 == 0, "community").otherwise("official").alias("source_authority"))


def _pages_sql() -> str:
    folder = "regexp_extract(url, '^([^?#]*?/)[^/?#]*/?(?:[?#].*)?$', 1)"
    return f"""p AS (SELECT page_id AS rank, {r.digest(r.canonical(folder))} AS identity_key, url AS title, {r.norm_title('url')} AS wording,
      CASE WHEN page_id % 11 = 0 THEN 'content-fingerprint' WHEN page_id % 7 = 0 THEN 'normalised-title-hash' ELSE 'canonical-url' END AS basis,
      CASE WHEN page_id % 3 = 0 THEN 'community' ELSE 'official' END AS authority FROM pages),
    census AS (SELECT identity_key, count(DISTINCT wording) AS features FROM p GROUP BY 1),
    graded AS (SELECT p.*, features, CASE WHEN basis = 'content-fingerprint' THEN 'low' WHEN basis <> 'canonical-url' AND wording = '' THEN 'low' WHEN basis <> 'canonical-url' THEN 'medium' WHEN features > 1 THEN 'medium' ELSE 'high' END AS confidence FROM p JOIN census USING (identity_key))"""


@query(f"WITH {_pages_sql()} SELECT * FROM census")
def identity_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.census(_pages(spark, sf_dir))


@query(f"WITH {_pages_sql()}, f AS (SELECT identity_key, wording, min_by(title, rank) AS title FROM p GROUP BY ALL) SELECT identity_key, count(*) AS features, string_agg(title, ' ' ORDER BY title) AS titles FROM f GROUP BY 1 HAVING count(*) > 1")
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.collisions(_pages(spark, sf_dir), "rank").select("identity_key", "features", F.array_join("titles", " ").alias("titles"))


@query(f"WITH {_pages_sql()} SELECT rank AS page_id, confidence AS identity_confidence, CASE WHEN confidence = 'high' AND authority = 'official' THEN 'approved' ELSE 'queued' END AS lifecycle FROM graded")
def confidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.gate(identity.grade(_pages(spark, sf_dir))).select(F.col("rank").alias("page_id"), "identity_confidence", "lifecycle")


@query(f"WITH {_pages_sql()} SELECT l.level AS identity_confidence, count(graded.rank) AS items FROM (VALUES ('high'), ('medium'), ('low')) l(level) LEFT JOIN graded ON confidence = level GROUP BY 1")
def confidence_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.confidence_tally(identity.grade(_pages(spark, sf_dir)))


@query(f"WITH {_pages_sql()} SELECT CASE WHEN confidence = 'high' AND authority = 'official' THEN 'approved' ELSE 'queued' END AS lifecycle, count(*) AS items FROM graded GROUP BY 1")
def gate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.gate(identity.grade(_pages(spark, sf_dir))).groupBy("lifecycle").agg(F.count("*").alias("items"))


_SCHEME = """SELECT '{name}' AS scheme, count(*) AS features, floor(100 * sum((in0 AND in1)::INT) / count(*))::BIGINT AS agreement, sum((titles > 1)::INT)::BIGINT AS merged, sum(greatest(titles - 1, 0))::BIGINT AS lost
FROM (SELECT {key} AS k, count(DISTINCT title) AS titles, bool_or(rank % 2 = 0) AS in0, bool_or(rank % 2 = 1) AS in1 FROM items GROUP BY 1)"""


@query(f"WITH {ITEMS} " + " UNION ALL ".join(_SCHEME.format(name=n, key=k) for n, k in (("source", "source"), ("title", "title"), ("source+title", "source || chr(1) || title"))))
def identity_scheme_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("side", F.col("rank") % 2)
    return identity.scheme_evaluation(rows, {"source": [F.col("source")], "title": [F.col("title")], "source+title": [F.col("source"), F.col("title")]}, "side")


# --- deduplication

KEYED = f"""{ITEMS}, keyed AS (SELECT rank, {r.digest(r.norm_title('title'))} AS key, {r.digest(r.line('title || chr(10) || summary'))} AS content FROM items)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select("rank", tx.digest(tx.normalise_title(F.col("title"))).alias("key"), tx.content_hash(F.col("title"), F.col("summary")).alias("content"), tx.title_tokens(F.col("title")).alias("tokens"))


@query(f"WITH {KEYED}, seen AS (SELECT key, min(rank) AS owner FROM keyed WHERE rank % 3 = 0 GROUP BY 1) SELECT rank AS doc_id, CASE WHEN owner IS NULL THEN 'new' ELSE 'known-identity' END AS verdict, owner::VARCHAR AS matched FROM keyed LEFT JOIN seen USING (key)")
def dedupe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    seen = k.filter("rank % 3 = 0").groupBy("key").agg(F.min("rank").cast("string").alias("owner"))
    return dedupe.against_seen(k, seen, "key", dedupe.KNOWN_IDENTITY).select(F.col("rank").alias("doc_id"), "verdict", "matched")


@query(f"WITH {KEYED}, seen AS (SELECT content, min(rank) AS owner FROM keyed WHERE rank % 3 = 0 GROUP BY 1) SELECT rank AS doc_id, CASE WHEN owner IS NULL THEN 'new' ELSE 'known-content' END AS verdict, owner::VARCHAR AS matched FROM keyed LEFT JOIN seen USING (content)")
def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    seen = k.filter("rank % 3 = 0").groupBy("content").agg(F.min("rank").cast("string").alias("owner"))
    return dedupe.against_seen(k, seen, "content", dedupe.KNOWN_CONTENT).select(F.col("rank").alias("doc_id"), "verdict", "matched")


#: Equal contents have equal keys here, so the first of each key is new and no other; tests cover keys and contents at odds.
@query(f"WITH {KEYED} SELECT rank AS doc_id, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY rank) = 1 THEN 'new' ELSE 'known-identity' END AS verdict FROM keyed")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact(_keyed(spark, sf_dir)).select(F.col("rank").alias("doc_id"), "verdict")


def _tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


_PAIRS = "SELECT a.rank AS a, b.rank AS b, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS score FROM t a JOIN t b ON a.rank < b.rank AND least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t)) AND len(a.t) > 0"


@query(f"WITH {ITEMS}, n AS (SELECT rank, {r.norm_title('title')} AS n FROM items), f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY rank) AS k FROM n), t AS (SELECT rank, {_tokens_sql('n')} AS t FROM f WHERE k = 1), pairs AS ({_PAIRS}) SELECT b AS doc_id, min_by(a, struct_pack(s := -score, a := a)) AS matched, round(max(score), 9) AS similarity FROM pairs WHERE score >= 0.85 GROUP BY b")
def dedupe_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    new = k.groupBy("key").agg(F.min("rank").alias("rank")).select("rank")  # what dedupe_exact finds new
    found = dedupe.near(k.join(new, "rank").select("rank", "tokens"))
    return found.select(F.col("rank").alias("doc_id"), F.col("matched_rank").alias("matched"), F.round("similarity", 9).alias("similarity"))


@query(f"WITH {KEYED} SELECT verdict, count(*) AS items FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY key ORDER BY rank) = 1 THEN 'new' ELSE 'known-identity' END AS verdict FROM keyed) GROUP BY 1")
def dedupe_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.tally(dedupe.exact(_keyed(spark, sf_dir)))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"WITH t AS (SELECT doc_id AS rank, {_WORDS} AS t FROM documents), pairs AS ({_PAIRS}) SELECT a, b, round(score, 9) AS score FROM pairs WHERE score >= 0.85")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similarity_join import similar_pairs

    tokens = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    sets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rank"), tokens.alias("tokens"))
    return similar_pairs(sets, "rank", "tokens", 0.85).select("a", "b", F.round("score", 9).alias("score"))


# --- queue, order, minting


@query(f"WITH {_pages_sql()} SELECT rank AS page_id, identity_key FROM graded WHERE identity_key NOT IN (SELECT identity_key FROM p WHERE rank % 4 = 0)")
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return review.enqueue(p, p.filter("rank % 4 = 0")).select(F.col("rank").alias("page_id"), "identity_key")


@query(f"WITH {OBJECTS} SELECT id, published_date, row_number() OVER (ORDER BY published_date NULLS LAST, id) AS place FROM objects")
def item_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places come from range-partitioned sorting; the rank itself is the oracle's way to see the order."""
    o = objects(spark, sf_dir).select("id", "published_date")
    by_day = o.groupBy("published_date").agg(F.count("*").alias("n"))
    # Days are few: counting those before, then ranking within a day, ranks everything without one sorted task.
    w = F.sum("n").over(_days())
    before = by_day.withColumn("before", w - F.col("n")).select(F.col("published_date").alias("day"), "before")
    place = F.row_number().over(_in_day()) + F.col("before")
    return o.join(before, o["published_date"].eqNullSafe(before["day"])).withColumn("place", place.cast("long")).select("id", "published_date", "place")


def _days():
    from pyspark.sql import Window

    return Window.orderBy(F.col("published_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)


def _in_day():
    from pyspark.sql import Window

    return Window.partitionBy("published_date").orderBy("id")


_MINT = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS published, (o_orderdate + INTERVAL 40 DAY)::DATE AS first_seen, o_orderpriority AS key FROM orders),
m AS (SELECT *, strftime(coalesce(published, first_seen), '%Y-%m') AS month_key FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY month_key ORDER BY published NULLS LAST, lpad(o_orderkey::VARCHAR, 12, '0')) + CASE WHEN month_key LIKE '%-01' THEN 100 ELSE 0 END AS sequence FROM m)"""


def _orders_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = o.select("o_orderkey", F.lit("ORD").alias("prefix"), F.when(F.col("o_orderkey") % 5 != 0, day).alias("published_date"), F.date_add(day, 40).alias("first_seen"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("identity_key"))
    months = rows.select("prefix", F.date_format(F.coalesce("published_date", "first_seen"), "yyyy-MM").alias("month_key")).distinct()
    return rows, months.filter("month_key like '%-01'").withColumn("counter", F.lit(100))


@query(f"WITH {_MINT} SELECT o_orderkey, month_key, sequence::BIGINT AS sequence, 'ORD-' || month_key || '-' || lpad(sequence::VARCHAR, greatest(3, length(sequence::VARCHAR))::INT, '0') AS id FROM n")
def mint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, counters = _orders_items(spark, sf_dir)
    return minting.mint(rows, counters).select("o_orderkey", "month_key", F.col("sequence").cast("long").alias("sequence"), "id")


@query(f"WITH {_MINT} SELECT month_key, max(sequence)::BIGINT AS counter FROM n GROUP BY 1")
def mint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, counters = _orders_items(spark, sf_dir)
    return minting.counters_after(minting.mint(rows, counters)).select("month_key", F.col("counter").cast("long").alias("counter"))


# --- updates


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def update_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_partkey", "l_linenumber"))
    return updates.update_winner(lines, "l_orderkey", "key").select("l_orderkey", "l_linenumber", "l_partkey")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it in its source, as if that were stored. Digests go through the window, texts do not."""
    from pyspark.sql import Window

    back = Window.partitionBy("source").orderBy("rank")
    compared = {"title": F.sha2("title", 256), "content_hash": tx.content_hash(F.col("title"), F.col("summary")), "identity_confidence": F.col("lang")}
    i = items(spark, sf_dir).select("rank", "source", *[value.alias(name) for name, value in compared.items()])
    i = i.withColumns({f"old_{name}": F.lag(name).over(back) for name in compared}).filter("old_title is not null")
    pairs = [(name, F.col(f"old_{name}"), F.col(name)) for name in compared]
    return i.withColumn("changed", updates.changed_fields(pairs))


_CHANGES = f"""{ITEMS}, l AS (SELECT *, lag(title) OVER w AS old_title, lag(summary) OVER w AS old_summary, lag(lang) OVER w AS old_lang FROM items WINDOW w AS (PARTITION BY source ORDER BY rank)),
c AS (SELECT rank, list_filter([CASE WHEN {r.line('title || chr(10) || summary')} <> {r.line('old_title || chr(10) || old_summary')} THEN 'content_hash' END, CASE WHEN lang <> old_lang THEN 'identity_confidence' END, CASE WHEN title <> old_title THEN 'title' END], lambda x: x IS NOT NULL) AS changed FROM l WHERE old_title IS NOT NULL)"""


@query(f"WITH {_CHANGES} SELECT rank AS doc_id, array_to_string(changed, ',') AS changed, len(list_filter(changed, lambda x: x <> 'identity_confidence')) > 0 AS material FROM c")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir)
    return c.select(F.col("rank").alias("doc_id"), F.array_join("changed", ",").alias("changed"), updates.is_material(F.col("changed")).alias("material"))


@query(f"WITH {_CHANGES} SELECT rank AS doc_id, CASE WHEN list_contains(changed, 'title') AND list_contains(changed, 'content_hash') THEN 'New title and new summary' WHEN list_contains(changed, 'title') THEN 'New title' WHEN list_contains(changed, 'content_hash') THEN 'New summary' ELSE 'Changed: ' || array_to_string(changed, ', ') END AS summary, CASE WHEN len(list_filter(changed, lambda x: x <> 'identity_confidence')) > 0 THEN 2 ELSE 1 END AS revisions FROM c")
def revision_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<revision:int,changed_fields:array<string>,summary:string>>"
    first = F.array(F.struct(F.lit(1).alias("revision"), F.array().cast("array<string>").alias("changed_fields"), F.lit("first").alias("summary"))).cast(kind)
    rows = _changes(spark, sf_dir).withColumn("revisions", first)
    after = updates.append_revision(rows, "revisions", "changed", {"summary": updates.describe(F.col("changed"))})
    return after.select(F.col("rank").alias("doc_id"), updates.describe(F.col("changed")).alias("summary"), F.size("revisions").alias("revisions"))


@query(f"""WITH {OBJECTS}, pairs AS (SELECT a.id AS old_id, b.id AS by FROM objects a JOIN objects b ON b.rank = a.rank + 1 WHERE a.rank % 10 = 1)
SELECT o.id, CASE WHEN p.by IS NOT NULL THEN 'replaced' ELSE status END AS status, p.by AS replaced_by, q.old_id AS replaces FROM objects o LEFT JOIN pairs p ON p.old_id = o.id LEFT JOIN pairs q ON q.by = o.id""")
def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).select("id", "rank", "status", F.lit(None).cast("string").alias("replaced_by"), F.lit(None).cast("string").alias("replaces"))
    later = o.select(F.col("id").alias("new_id"), (F.col("rank") - 1).alias("before"))
    pairs = o.filter("rank % 10 = 1").join(later, F.col("rank") == F.col("before")).select(F.col("id").alias("old_id"), "new_id")
    return updates.supersede(o, pairs).select("id", "status", "replaced_by", "replaces")


# --- classification

RULES = {
    "tier": [classify.Rule("1", ("er", "und"), ("que",), "anglo"), classify.Rule(None, ("la",)), classify.Rule("2", ("la ", "le "))],
    "category": [classify.Rule("toxic", ("idiot", "scum", "moron")), classify.Rule("table", ("|",), ("###",)), classify.Rule("prose", (". ",))],
    "tags": [classify.Rule("english", (" the ",)), classify.Rule("french", (" les ", " une ")), classify.Rule("german", (" der ", " und ")), classify.Rule("code", ("###", "$$$"))],
}


def _match_sql(rule: classify.Rule) -> str:
    some = lambda terms: " OR ".join(f"contains(h, '{t.lower()}')" for t in terms)
    return f"({some(rule.any)})" + (f" AND NOT ({some(rule.none)})" if rule.none else "")


def _first_sql(axis: str, what: str) -> str:
    cases = [f"WHEN {_match_sql(x)} THEN '{x.value if what == 'value' else x.name or f'{axis}[{k}]'}'" for k, x in enumerate(RULES[axis]) if x.value is not None]
    return f"CASE {' '.join(cases)} END"


_HAY = f"{ITEMS}, hay AS (SELECT rank, lower(title || ' ' || {r.slug('title')} || ' ' || summary) AS h FROM items)"


def _hay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select(F.col("rank").alias("doc_id"), classify.haystack(F.col("title"), tx.slugify(F.col("title")), F.col("summary")).alias("h"))


@query(f"WITH {_HAY} SELECT rank AS doc_id, {_first_sql('tier', 'value')} AS tier, {_first_sql('tier', 'name')} AS matched_by FROM hay")
def classify_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hay(spark, sf_dir).select("doc_id", classify.first_match(F.col("h"), RULES["tier"], "tier").alias("m"))
    return found.select("doc_id", F.col("m.value").alias("tier"), "m.matched_by")


@query(f"WITH {_HAY} SELECT rank AS doc_id, {_first_sql('category', 'value')} AS category, {_first_sql('category', 'name')} AS matched_by FROM hay")
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hay(spark, sf_dir).select("doc_id", classify.first_match(F.col("h"), RULES["category"], "category").alias("m"))
    return found.select("doc_id", F.col("m.value").alias("category"), "m.matched_by")


_TAGS = "[" + ", ".join(f"CASE WHEN {_match_sql(x)} THEN '{x.value}' END" for x in RULES["tags"]) + "]"


@query(f"WITH {_HAY} SELECT rank AS doc_id, array_to_string(list_sort(list_filter({_TAGS}, lambda x: x IS NOT NULL)), ',') AS tags FROM hay")
def classify_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hay(spark, sf_dir).select("doc_id", F.array_join(classify.all_matches(F.col("h"), RULES["tags"]), ",").alias("tags"))


@query(f"WITH {_HAY} SELECT ({_first_sql('tier', 'value')} IS NULL OR {_first_sql('category', 'value')} IS NULL) AS needs_review, count(*) AS items FROM hay GROUP BY 1")
def classify_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [classify.first_match(F.col("h"), RULES[a], a) for a in ("tier", "category")]
    return _hay(spark, sf_dir).groupBy(classify.needs_review(*axes).alias("needs_review")).agg(F.count("*").alias("items"))


# --- across packs


def _page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir)
    path = urls.canonical_url(F.regexp_replace("url", "^[^:]*://[^/?#]*", "https://all.example"))
    return p.select(F.col("rank").alias("id"), "pack", tx.digest(path).alias("url_hash"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


_PAGE_OBJECTS = f"""po AS (SELECT page_id AS id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS pack, {r.digest(r.canonical("regexp_replace(url, '^[^:]*://[^/?#]*', 'https://all.example')"))} AS url_hash, sha256(html) AS content_hash FROM pages)"""
_GROUPS = "SELECT '{basis}' AS basis, {key} AS key, string_agg(id::VARCHAR, '+' ORDER BY id::VARCHAR) AS ids, count(DISTINCT pack) AS packs, count(*) AS sides FROM po GROUP BY {key} HAVING count(DISTINCT pack) > 1"


@query(f"WITH {_PAGE_OBJECTS} {_GROUPS.format(basis='url', key='url_hash')}")
def crosspack_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspack.shared_groups(_page_objects(spark, sf_dir), "url", "url_hash")


@query(f"WITH {_PAGE_OBJECTS}, u AS ({_GROUPS.format(basis='url', key='url_hash')}), c AS ({_GROUPS.format(basis='content', key='content_hash')}) SELECT * FROM u UNION ALL SELECT * FROM c WHERE ids NOT IN (SELECT ids FROM u)")
def crosspack_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspack.duplicate_groups(_page_objects(spark, sf_dir))


@query(f"WITH {_PAGE_OBJECTS}, u AS ({_GROUPS.format(basis='url', key='url_hash')}) SELECT basis, ids FROM u WHERE sides <> 2")
def crosspack_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = crosspack.shared_groups(_page_objects(spark, sf_dir), "url", "url_hash")
    return crosspack.outstanding(groups, groups.filter("sides = 2")).select("basis", "ids")


_SIDES = {"url": "url_hash", "content": "content_hash"}
_ALL_GROUPS = f"{_PAGE_OBJECTS}, u AS ({_GROUPS.format(basis='url', key='url_hash')}), c AS ({_GROUPS.format(basis='content', key='content_hash')}), g AS (SELECT * FROM u UNION ALL SELECT * FROM c WHERE ids NOT IN (SELECT ids FROM u))"


@query(f"WITH {_ALL_GROUPS} SELECT basis, key, po.pack, id::VARCHAR AS id, 'id: ' || id::VARCHAR || chr(10) || 'pack: ' || po.pack AS facts FROM g JOIN po ON key = CASE basis WHEN 'url' THEN url_hash ELSE content_hash END")
def crosspack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _page_objects(spark, sf_dir)
    return crosspack.evidence(crosspack.duplicate_groups(o), o, _SIDES, ["id", "pack"])


@query(f"WITH {_ALL_GROUPS} SELECT CASE WHEN sides = 2 THEN 'info' ELSE 'warning' END AS level, 'XPK001' AS code, ids AS location, 'same ' || basis AS message FROM g")
def crosspack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = crosspack.duplicate_groups(_page_objects(spark, sf_dir))
    return validate.duplicates(groups, groups.filter("sides = 2"))
