"""URL filters by expressions: host suffixes with path prefixes, met on short hash prefixes.

A URL is expanded into expressions, a suffix of its host's labels followed by a prefix of its path. Rules are such
expressions too, so a URL's rules are found by equality. Only the shapes that rules have are expanded: how many labels and
how many code points of path. Expressions meet rules in an equi-join on the first SHORT digits of their SHA-256, and the
full digest confirms what met. Of a URL's confirmed rules the longest decides.

Distinct hosts and paths are expanded, not rows, so a URL that very many rows bear is expanded once. An expression that
very many URLs share (a rule of a top-level domain) is spread over SALTS keys, and rules are repeated for each. What is found comes back to the rows by host and path; that
side has one row a key, so the other side can be split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix, quoted

#: Hexadecimal digits of the hash prefix that the join goes by.
SHORT = 8
#: Keys that an expression's URLs are dealt over.
SALTS = 16
#: What a rule may have: labels of its host and code points of its path. A host name of the DNS has at most 127 labels.
MOST_LABELS, MOST_PATH = 127, 2_048
#: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
RULE_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What is between the first `://` and the next `/`, `?` or `#`, A-Z in lower case; empty for null and where there is no `://`."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What is between the host and the next `?` or `#`; empty for null and where there is no `://`."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash and a path begins with one or is empty, so that the two can be told apart when joined."""
    return F.sha2(F.concat(host, path), 256)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def prepared(rules: DataFrame) -> DataFrame:
    """host, path, verdict, labels, length and digest of each rule once. Hosts count in lower case (A-Z), null parts as empty; of rules for the same host and path, block wins.

    A rule with an unknown verdict, with a slash in its host, or beyond MOST_LABELS or MOST_PATH, is an error.
    """
    known = F.col("verdict").isin("allow", "block")
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    each = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.when(known, F.col("verdict")), F.lit("?")).alias("verdict"))
    each = each.groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("verdict").alias("least"))
    each = each.select("host", "path", "verdict", "least", _labels(F.col("host")).alias("labels"), F.length("path").alias("length"))
    wrong = (F.col("least") == "?") | F.col("host").contains("/") | (F.col("labels") > MOST_LABELS) | (F.col("length") > MOST_PATH)
    verdict = F.when(wrong, F.raise_error(F.concat(F.lit("not a rule: "), "host", "path"))).otherwise(F.col("verdict"))
    return each.select("host", "path", verdict.alias("verdict"), "labels", "length", _digest(F.col("host"), F.col("path")).alias("digest"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict: of each row of urls (host, path; distinct) that any rule fits, the longest rule (in code points; then that of the longer host)."""
    found = prepared(rules)
    # At most MOST_LABELS * (MOST_PATH + 1) shapes, however many rules there are.
    shapes = found.filter(F.length("verdict") > 0).select("labels", "length").distinct().collect()
    if not shapes:
        return urls.sparkSession.createDataFrame([], "host string, path string, rule string, verdict string")
    array = F.array(*[F.struct(F.lit(r.labels).alias("labels"), F.lit(r.length).alias("length")) for r in sorted(shapes)])
    each = urls.select("host", "path", F.explode(array).alias("shape"))
    each = each.filter((_labels(F.col("host")) >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.length")))
    suffix = F.expr("substring_index(host, '.', -shape.labels)")
    digest = _digest(suffix, F.col("path").substr(F.lit(1), F.col("shape.length")))
    each = each.select("host", "path", digest.alias("full")).select("*", F.substring("full", 1, SHORT).alias("short"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt"))
    salted = found.select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict", "digest", F.substring("digest", 1, SHORT).alias("short"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    )
    met = each.join(salted, ["short", "salt"]).filter(F.col("full") == F.col("digest"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length"))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def url_filter(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (host and path of the rule that decides, else null) and verdict (allow or block) for each row of pages.

    A rule fits its host and all subdomains where the URL's path starts with the rule's; the longest rule wins. URLs that
    no rule fits have the verdict `default`: what no list names is let through. A null URL, or one without `://`, has an
    empty host and path, which only a rule with an empty path and host can fit. Rows that repeat stay rows of their own,
    and no rows give no rows. Extra columns are ignored, whatever their names. rules (host, path, verdict): RULES where None.
    """
    rules = default_rules(pages.sparkSession) if rules is None else rules
    p = prefix(pages)
    url = quoted([url_col])[0]
    rows = pages.select(quoted([id_col])[0].alias(p + "id"), url_host(url).alias(p + "host"), url_path(url).alias(p + "path"))
    urls = rows.groupBy(F.col(p + "host").alias("host"), F.col(p + "path").alias("path")).agg(F.count("*").alias("n")).select("host", "path")
    found = matches(urls, rules)
    both = rows.join(found, (F.col(p + "host") == F.col("host")) & (F.col(p + "path") == F.col("path")), "left")
    return both.select(F.col(p + "id").alias(id_col), F.col(p + "host").alias("host"), F.col(p + "path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {_VALUES}) t(h, p, verdict)),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
parts AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
    SELECT k, max_by(h || p, length(h || p) * 1000 + length(h)) AS rule, max_by(verdict, length(h || p) * 1000 + length(h)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (k)
"""
