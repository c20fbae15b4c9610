"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digest

#: Query parameters that name a campaign, not a page (fixed values).
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "wt.mc_id", "ocid", "cid", "culture", "country", "fbclid", "gclid",
    "msclkid", "src", "ref", "referrer", "s_cid", "epi", "irgwc", "irclickid",
)




def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slashes, no tracking parameters; the other parameters sorted."""
    url = F.trim(url)
    part = lambda k: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?", k)
    pairs = F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~F.lower(_key(x)).isin(*TRACKING))
    sorted_pairs = F.array_sort(F.transform(pairs, lambda x: F.struct(_key(x).alias("k"), _value(x).alias("v"))))
    query = F.array_join(F.transform(sorted_pairs, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    return F.concat(scheme, F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _key(pair: Column) -> Column:
    return _decoded(F.regexp_extract(pair, "^([^=]*)", 1))


def _value(pair: Column) -> Column:
    return _decoded(F.regexp_extract(pair, "^[^=]*=?(.*)$", 1))


def url_hash(url: Column) -> Column:
    return digest(canonical_url(url))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def is_web_url(url: Column) -> Column:
    return url.rlike("^(?i)https?://")


def fold_path(path: Column) -> Column:
    """`.` and `..` taken out of a relative path; `..` above its start stay in front."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), done), -1), F.lit("..")) != "..")
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(up, shorter).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_doc_link(target: Column, doc_path: str, docs_prefix: str, base_url: str) -> Column:
    """The page that a link of a Markdown document leads to; null for anchors, other files, and links out of the documents."""
    return doc_link(target, F.lit(doc_path.rpartition("/")[0]), F.lit(docs_prefix), F.lit(base_url))


def doc_link(target: Column, folder: Column, docs_prefix: Column, base_url: Column) -> Column:
    """resolve_doc_link() for documents of many places: the folder of each, the prefix of published paths and the address of their pages."""
    bare = F.regexp_extract(target, "^([^#]*)", 1)
    path = fold_path(F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), bare))
    path = F.when(F.startswith(path, docs_prefix), F.substr(path, F.length(docs_prefix) + 1)).otherwise(path)
    page = F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), "^/+", ""))
    return (
        F.when(target.isNull() | (target == "") | F.startswith(target, F.lit("#")), None)
        .when(target.rlike("^https?://"), canonical_url(target))
        .when(bare.endswith(".md") & ~F.startswith(path, F.lit("../")), canonical_url(page))
    )
