"""Registered queries, each with the SQL that DuckDB answers it by, and pieces of such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.redact import PATTERNS, REDACTED
from ..functions.text import TITLE_NOISE
from ..functions.urls import TRACKING

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def line(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({line(x)}, ' '), lambda w: w <> '')"


def digest(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def norm_title(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({_list(TITLE_NOISE)}, w))), ' ')"


def slug(x: str, most: int = 60) -> str:
    whole = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    head = f"substr({whole}, 1, {most})"
    cut = f"regexp_replace({head}, '-[^-]*$', '')"
    return f"CASE WHEN {whole} = '' THEN 'untitled' WHEN length({whole}) <= {most} THEN {whole} WHEN {cut} = '' THEN {head} ELSE {cut} END"


def truncated(x: str, most: int) -> str:
    w = words(x)
    return f"CASE WHEN len({w}) <= {most} THEN array_to_string({w}, ' ') ELSE regexp_replace(array_to_string(({w})[1:{most}], ' '), '[,;:]+$', '') || '…' END"


def canonical(x: str) -> str:
    """For URLs whose parameters need no decoding."""
    part = lambda k: f"regexp_extract({x}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\\?([^#]*))?', {k})"
    kept = f"list_sort(list_filter(string_split({part(4)}, '&'), lambda p: p <> '' AND NOT list_contains({_list(TRACKING)}, lower(string_split(p, '=')[1]))))"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    return f"lower({part(1)}) || ':' || lower({part(2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def redacted(x: str) -> str:
    for p in PATTERNS:
        flags = "gi" if p.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, '{p.removeprefix('(?i)')}', '{REDACTED}', '{flags}')"
    return x
