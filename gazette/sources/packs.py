"""Collections' configuration: YAML on any store that Spark reads."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import Rule, rules_from_config
from .items import Source

REQUIRED = ("name", "id_prefix", "schema_version")
PACKS = "pack string, name string, id_prefix string, schema_version int, near_duplicate_threshold double, max_summary_words int, error string"


class PackError(ValueError):
    pass


def parse_pack(text: str) -> dict:
    try:
        config = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PackError(f"no YAML: {e}") from e
    if not isinstance(config, dict):
        raise PackError("no mapping")
    if missing := [k for k in REQUIRED if k not in config]:
        raise PackError(f"lacks {', '.join(missing)}")
    return config


def source_of(entry: dict) -> Source:
    if not str(entry.get("url", "")).lower().startswith(("http://", "https://")):
        raise PackError(f"not a web URL: {entry.get('url')}")
    fallbacks = tuple(source_of(f) for f in entry.get("fallbacks") or ())
    known = {k: entry[k] for k in ("name", "url", "authority", "status", "role", "options") if k in entry}
    return Source(kind=entry.get("type", "rss"), fallbacks=fallbacks, **known)


def read_packs(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, list[Source]], dict[str, dict[str, list[Rule]]]]:
    """A row for each pack under root (`*/pack.yml`), its sources and its rules. A pack that cannot be read has an error and no others."""
    rows, sources, rules = [], {}, {}
    for r in sorted(spark.read.text(f"{root}/*/pack.yml", wholetext=True).select("_metadata.file_path", "value").collect()):
        pack = r[0].split("/")[-2]
        try:
            config = parse_pack(r[1])
            sources[pack] = [source_of(s) for s in config.get("sources") or ()]
            rules[pack] = rules_from_config(config.get("classification") or {})
            limits = config.get("limits") or {}
            rows.append((pack, config["name"], config["id_prefix"], config["schema_version"], float((config.get("dedupe") or {}).get("near_duplicate_threshold", 0.85)), int(limits.get("max_summary_words", 120)), None))
        except PackError as e:
            rows.append((pack, None, None, None, None, None, str(e)))
    return spark.createDataFrame(rows, PACKS), sources, rules


CONFIGS = "pack string, name string, id_prefix string, schema_version int, max_summary_words int, categories array<string>, error string"


def _number(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _named_sources(entries) -> list[tuple[str, str]]:
    """(name, url) of sources and of all their fallbacks, whatever they look like."""
    out = []
    for e in entries or ():
        if isinstance(e, dict):
            out += [(str(e.get("name")), str(e.get("url")))] if e.get("role") != "manual-review" else []
            out += _named_sources(e.get("fallbacks"))
    return out


def read_configs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Configurations as they stand, for rules to judge: CONFIGS with a null for what is missing, and (pack, name, url) of all sources. error: no YAML, or no mapping."""
    rows, sources = [], []
    for r in sorted(spark.read.text(f"{root}/*/pack.yml", wholetext=True).select("_metadata.file_path", "value").collect()):
        pack = r[0].split("/")[-2]
        try:
            config = yaml.safe_load(r[1])
            if not isinstance(config, dict):
                raise PackError("no mapping")
        except (yaml.YAMLError, PackError) as e:
            rows.append((pack, None, None, None, None, None, str(e)))
            continue
        text = lambda k: None if config.get(k) is None else str(config[k])  # noqa: B023, E731
        limits = config.get("limits") if isinstance(config.get("limits"), dict) else {}
        categories = config.get("categories")
        rows.append((pack, text("name"), text("id_prefix"), _number(config.get("schema_version")), _number(limits.get("max_summary_words")) or 120, [str(c) for c in categories] if isinstance(categories, list) else [], None))
        sources += [(pack, *s) for s in _named_sources(config.get("sources"))]
    return spark.createDataFrame(rows, CONFIGS), spark.createDataFrame(sources, "pack string, name string, url string")
