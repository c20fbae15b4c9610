"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, redact, text, urls
from ..functions.html import html_to_text
from ..operators import digest
from . import registry as r
from .registry import query, table
from .views import ITEMS, items

TEXT = "coalesce(text, '')"


@query(f"SELECT page_id, {r.canonical('url')} AS canonical_url FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT page_id, {r.digest(r.canonical('url'))} AS url_hash FROM pages")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_matches(url, '^(?i)https?://') AS web FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.is_web_url(F.col("url")).alias("web"))


@query(f"WITH {ITEMS} SELECT rank AS doc_id, {r.digest(r.line('title || chr(10) || summary'))} AS content_hash FROM items")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.col("rank").alias("doc_id"), text.content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


_VISIBLE = r"""replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?--\s*>|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|<[a-zA-Z/!?][^>]*>', ' ', 'g'), '<', ' < ')"""
#: The entities that the pages have.
for _name, _is in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '&{_name};?', '{_is}', 'g')"


@query(f"SELECT page_id, {r.line(_VISIBLE)} AS page_text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = html_to_text(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", visible.alias("page_text"))


@query(f"SELECT doc_id, {r.truncated(TEXT, 120)} AS summary FROM documents")
def summary_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_summary(F.coalesce("text", F.lit("")), 120).alias("summary"))


#: Order dates as feeds and tables write them; the last form holds none.
def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    written = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 2, F.date_format(d, "MMMM yyyy"))
        .when(k == 3, F.concat(F.lit("released "), F.date_format(d, "MMMM d yyyy"), F.lit(" to all")))
        .when(k == 4, F.lit("since 2021 or so"))
        .otherwise(F.lit("no date"))
    )
    return o.select("o_orderkey", d.cast("date").alias("day"), k.alias("k"), written.alias("written"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 3) THEN o_orderdate::DATE WHEN o_orderkey % 6 = 2 THEN date_trunc('month', o_orderdate)::DATE
                              WHEN o_orderkey % 6 = 4 THEN DATE '2021-01-01' END AS date,
              CASE WHEN o_orderkey % 6 = 2 THEN 'month' WHEN o_orderkey % 6 = 4 THEN 'year' ELSE 'day' END AS precision,
              CASE WHEN o_orderkey % 6 < 4 THEN 'exact' ELSE 'inferred' END AS confidence FROM orders"""
)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", dates.parse_date(F.col("written")).alias("p")).select("o_orderkey", "p.*")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN o_orderdate::DATE WHEN o_orderkey % 6 = 2 THEN date_trunc('month', o_orderdate)::DATE END AS date,
              CASE WHEN o_orderkey % 6 = 2 THEN 'month' ELSE 'day' END AS precision, CASE WHEN o_orderkey % 6 < 3 THEN 'exact' ELSE 'inferred' END AS confidence FROM orders"""
)
def date_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", dates.parse_date_cell(F.col("written")).alias("p")).select("o_orderkey", "p.*")


@query("SELECT event_id, strftime(ts, '%G-W%V') AS iso_week FROM events")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.iso_week(F.col("ts").cast("date")).alias("iso_week"))


@query(f"WITH {ITEMS} SELECT rank AS doc_id, {r.slug('title')} AS slug FROM items")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.col("rank").alias("doc_id"), text.slugify(F.col("title")).alias("slug"))


@query(f"WITH {ITEMS} SELECT rank AS doc_id, {r.norm_title('title')} AS normalised FROM items")
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.col("rank").alias("doc_id"), text.normalise_title(F.col("title")).alias("normalised"))


@query(f"SELECT doc_id, sha256({r.line(TEXT)}) AS line_sha256, sha256(trim(regexp_replace(lower({TEXT}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS folded_sha256 FROM documents")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.single_line(t), 256).alias("line_sha256"), F.sha2(text.fold(t), 256).alias("folded_sha256"))


@query(f"SELECT doc_id, greatest(1, ceil(len({r.words(TEXT)}) / 200.0))::INT AS minutes FROM documents")
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.reading_time(F.coalesce("text", F.lit(""))).alias("minutes"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 AND o_orderkey % 4 < 2 THEN year(o_orderdate)::VARCHAR || ' Release Wave ' || (o_orderkey % 2 + 1)::VARCHAR END AS version FROM orders")
def version_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    named = F.concat(F.lit("in "), F.year("o_orderdate").cast("string"), F.lit(" release  WAVE "), (k % 2 + 1).cast("string"))
    said = F.when(k % 4 < 2, named).otherwise("in a release wave")
    return o.select("o_orderkey", text.release_wave(said).alias("version"))


@query(f"SELECT doc_id, sha256({r.line("regexp_replace(" + TEXT + ", '\\*\\*|__|\\*|_|`', '', 'g')")}) AS plain_sha256 FROM documents")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_markdown(F.coalesce("text", F.lit(""))), 256).alias("plain_sha256"))


@query(
    """SELECT o_orderkey, 'ORD' AS prefix, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_orderkey AS sequence, strftime(o_orderdate, '%Y-%m') AS month_key,
              strftime(o_orderdate, '%Y/%m/') || 'ORD-' || strftime(o_orderdate, '%Y-%m-') || lpad(o_orderkey::VARCHAR, greatest(3, length(o_orderkey::VARCHAR))::INT, '0') AS subpath FROM orders"""
)
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    made = ids.format_id(F.lit("ORD"), F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_orderkey"))
    return o.select("o_orderkey", ids.parse_id(made).alias("p")).select("o_orderkey", "p.*")


@query(f"SELECT doc_id, sha256({r.redacted(TEXT)}) AS redacted_sha256, {TEXT} <> {r.redacted(TEXT)} AS changed FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), redact.redact(t).alias("r"))
    return rows.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), (F.col("t") != F.col("r")).alias("changed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[redacted]' ELSE substr(c_name, 1, 1) || '***@example.org' END AS masked FROM customer")
def address_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    written = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@example.org")))
    return c.select("c_custkey", redact.mask_address(written).alias("masked"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 100 // 50 * l_quantity >= 0 AND floor(100 * l_linenumber / l_quantity) >= 1 THEN floor(100 * l_linenumber / l_quantity)::BIGINT::VARCHAR || '%' ELSE '' END AS share FROM lineitem")
def percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.percent(F.col("l_linenumber"), F.col("l_quantity")).alias("share"))


@query(f"SELECT doc_id, sha256('# ' || split_part({TEXT}, chr(10), 1) || chr(10) || chr(10) || {r.truncated(TEXT, 108)} || chr(10) || chr(10) || 'Source: ' || source || chr(10)) AS article_sha256 FROM documents")
def article_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select(F.col("rank").alias("doc_id"), F.sha2(digest.article(F.col("title"), F.col("summary"), F.col("source")), 256).alias("article_sha256"))
