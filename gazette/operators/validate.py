"""Integrity rules. Each is a query that returns findings: level, code, location, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import PATTERN, parse_id

ERROR, WARNING, INFO = "error", "warning", "info"


def finding(rows: DataFrame, level: str, code: str, location: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), location.cast("string").alias("location"), message.alias("message"))


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "code").agg(F.count("*").alias("findings"))


def fails_build(findings: DataFrame, strict: bool = False) -> bool:
    """Whether there is an error; if strict, anything but information."""
    return not findings.filter(F.col("level") != INFO if strict else F.col("level") == ERROR).isEmpty()


def pack_config(packs: DataFrame, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """PACK001-003: of packs (pack, name, id_prefix, schema_version), what is missing or wrong."""
    at = F.col("pack")
    missing = [finding(packs.filter(F.col(c).isNull()), ERROR, "PACK001", at, F.lit(f"{c} is missing")) for c in ("name", "id_prefix", "schema_version")]
    return union(
        [
            *missing,
            finding(packs.filter(~F.col("schema_version").isin(*versions)), ERROR, "PACK002", at, F.concat(F.lit("unknown schema version "), F.col("schema_version").cast("string"))),
            finding(packs.filter(~F.col("id_prefix").rlike("^[A-Z]{2,4}$")), ERROR, "PACK003", at, F.concat(F.lit("not 2 to 4 capitals: "), F.col("id_prefix"))),
        ]
    )


def pack_exists(packs: DataFrame, names: list[str]) -> DataFrame:
    """PACK000: names that no pack (pack) has."""
    asked = packs.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return finding(asked.join(packs.select(F.col("pack").alias("name")), "name", "left_anti"), ERROR, "PACK000", F.col("name"), F.lit("no such pack"))


def pack_state(packs: DataFrame, folders: DataFrame) -> DataFrame:
    """PACK004: packs (pack) that have no state folder (folders: pack)."""
    return finding(packs.join(folders.select("pack").distinct(), "pack", "left_anti"), ERROR, "PACK004", F.col("pack"), F.lit("no state folder"))


def unloadable(packs: DataFrame) -> DataFrame:
    """PACK005: packs (pack, error) whose configuration cannot be read; the others go on."""
    return finding(packs.filter("error is not null"), ERROR, "PACK005", F.col("pack"), F.col("error"))


def escaping_links(links: DataFrame) -> DataFrame:
    """SEC001: links (path, target) that lead out of the root, as sources.paths.links_outside() finds them."""
    return finding(links, ERROR, "SEC001", F.col("path"), F.concat(F.lit("leads to "), F.col("target")))


def object_files(documents: DataFrame) -> DataFrame:
    """OBJ002-004: object folders (path, has_metadata, has_article, is_mapping) without metadata, without an article, or whose metadata is no mapping."""
    at = F.col("path")
    return union(
        [
            finding(documents.filter("not has_metadata"), ERROR, "OBJ002", at, F.lit("no metadata")),
            finding(documents.filter("not has_article"), ERROR, "OBJ003", at, F.lit("no article")),
            finding(documents.filter("has_metadata and not is_mapping"), ERROR, "OBJ004", at, F.lit("the metadata is no mapping")),
        ]
    )


def schema_version(objects: DataFrame, versions: tuple[int, ...] = (1,), ident: str = "id") -> DataFrame:
    """SCHEMA001: objects of an unknown schema version, or of none."""
    bad = objects.filter(F.col("schema_version").isNull() | ~F.col("schema_version").isin(*versions))
    return finding(bad, ERROR, "SCHEMA001", F.col(ident), F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))


def registry_readable(registries: DataFrame) -> DataFrame:
    """REG001: packs (pack, error) whose registry cannot be read."""
    return finding(registries.filter("error is not null"), ERROR, "REG001", F.col("pack"), F.concat(F.lit("the registry cannot be read: "), F.col("error")))


def references(dangling: DataFrame, packs: int) -> DataFrame:
    """REF001: of crosspack.dangling(), where two packs or more were read; with one, what it refers to may lie in another."""
    return finding(dangling.filter(F.lit(packs > 1)), ERROR, "REF001", F.col("id"), F.concat_ws(" ", "field", F.col("target").cast("string")))


def duplicates(groups: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """XPK001: groups of objects in several packs are warnings, and information once someone has acknowledged them (ids)."""
    known = acknowledged.select("ids").distinct().withColumn("known", F.lit(True))
    level = F.when(F.col("known"), INFO).otherwise(WARNING)
    return groups.join(known, "ids", "left").select(level.alias("level"), F.lit("XPK001").alias("code"), F.col("ids").alias("location"), F.concat(F.lit("same "), "basis").alias("message"))


def scan_summary(objects: DataFrame) -> DataFrame:
    """(packs, objects): how much was checked."""
    return objects.agg(F.count_distinct("pack").alias("packs"), F.count("*").alias("objects"))


def source_urls(sources: DataFrame) -> DataFrame:
    """SEC002: sources whose URL is none of the web."""
    return finding(sources.filter(~F.col("url").rlike("^(?i)https?://")), ERROR, "SEC002", F.col("name"), F.concat(F.lit("not a web URL: "), F.col("url")))


def identifiers(objects: DataFrame) -> DataFrame:
    """OBJ001, ID002 and ID004: of objects (id, prefix, path: yyyy/mm/name), identifiers that disagree with name, prefix or month of their place."""
    parsed = objects.withColumn("parsed", parse_id(F.col("id")))
    month = F.substring_index("path", "/", 2)
    well = parsed.filter("parsed is not null")
    return union(
        [
            finding(parsed.filter(F.substring_index("path", "/", -1) != F.col("id")), ERROR, "OBJ001", F.col("path"), F.concat(F.lit("holds "), F.col("id"))),
            finding(parsed.filter(~F.col("id").rlike(PATTERN)), ERROR, "ID001", F.col("path"), F.concat(F.lit("malformed identifier "), F.col("id"))),
            finding(well.filter(F.col("parsed.prefix") != F.col("prefix")), ERROR, "ID002", F.col("id"), F.concat(F.lit("the prefix here is "), F.col("prefix"))),
            finding(well.filter(F.replace(F.col("parsed.month_key"), F.lit("-"), F.lit("/")) != month), ERROR, "ID004", F.col("id"), F.concat(F.lit("is under "), month)),
        ]
    )


def duplicate_ids(objects: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """ID003: all but the first object of each identifier."""
    turn = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    again = objects.withColumn("turn", turn).filter("turn > 1")
    return finding(again, ERROR, "ID003", F.col(ident), F.concat(F.lit("occurrence "), F.col("turn").cast("string")))


def schema_keys(documents: DataFrame, keys: Column, expected: list[str], at: Column) -> DataFrame:
    """SCHEMA002 and SCHEMA004: keys that a document lacks, and keys that no schema has."""
    all_keys = F.array(*[F.lit(k) for k in expected])
    rows = documents.select(at.alias("at"), F.array_except(all_keys, keys).alias("missing"), F.array_except(keys, all_keys).alias("unknown"))
    lacks = rows.select("at", F.explode("missing").alias("key"))
    extra = rows.select("at", F.explode("unknown").alias("key"))
    return finding(lacks, ERROR, "SCHEMA002", F.col("at"), F.concat(F.lit("lacks "), F.col("key"))).unionByName(
        finding(extra, WARNING, "SCHEMA004", F.col("at"), F.concat(F.lit("unknown key "), F.col("key")))
    )


def vocabulary(objects: DataFrame, column: str, allowed: tuple[str, ...], ident: str = "id") -> DataFrame:
    """SCHEMA003: values that are none of a closed vocabulary."""
    bad = objects.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return finding(bad, ERROR, "SCHEMA003", F.col(ident), F.concat(F.lit(f"{column} is "), F.col(column)))


def undeclared_category(objects: DataFrame, declared: DataFrame, ident: str = "id") -> DataFrame:
    """SCHEMA005: categories that the pack does not declare (category)."""
    bad = objects.filter("category is not null").join(declared.select("category"), "category", "left_anti")
    return finding(bad, WARNING, "SCHEMA005", F.col(ident), F.concat(F.lit("undeclared category "), F.col("category")))


def overrides(objects: DataFrame, proposed: list[str], known: list[str], ident: str = "id") -> DataFrame:
    """OWN001 and OWN002: locks on fields that cannot be locked, and on fields that do not exist."""
    each = objects.select(ident, F.explode("overrides").alias("field"))
    return finding(each.filter(F.col("field").isin(*known) & ~F.col("field").isin(*proposed)), ERROR, "OWN001", F.col(ident), F.concat(F.lit("cannot be locked: "), F.col("field"))).unionByName(
        finding(each.filter(~F.col("field").isin(*known)), ERROR, "OWN002", F.col(ident), F.concat(F.lit("no such field: "), F.col("field")))
    )


def artifacts(objects: DataFrame, files: DataFrame, folders: tuple[str, ...] = ("artifacts", "images"), ident: str = "id") -> DataFrame:
    """GEN001-003: generated artifacts without a path, outside the artifact folders, or whose file (path; with the identifier, if files has it) is not there."""
    made = objects.select(ident, F.explode("generation").alias("kind", "g")).filter(F.col("g.status").isin("generated", "stale"))
    made = made.select(ident, "kind", F.col("g.path").alias("path"))
    on = [ident, "path"] if ident in files.columns else ["path"]
    safe = F.col("path").rlike(rf"^({'|'.join(folders)})/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)|\\")
    return union(
        [
            finding(made.filter("path is null"), ERROR, "GEN001", F.col(ident), F.concat(F.lit("no path for "), F.col("kind"))),
            finding(made.filter(F.col("path").isNotNull() & ~safe), ERROR, "GEN002", F.col(ident), F.concat(F.lit("outside the artifact folders: "), F.col("path"))),
            finding(made.filter(safe).join(files.select(*on), on, "left_anti"), ERROR, "GEN003", F.col(ident), F.concat(F.lit("no such file: "), F.col("path"))),
        ]
    )


def article(objects: DataFrame, limit: int | Column, ident: str = "id") -> DataFrame:
    """CONS001, CONS002 and COPY001: of objects (id, title, body), articles without a heading, with another than the title, and with too many words below it."""
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    below = F.trim(F.regexp_replace(F.regexp_replace("body", r"(?m)^#\s+.*$", ""), r"\s+", " "))
    n = F.when(below == "", 0).otherwise(F.size(F.split(below, " ")))
    return union(
        [
            finding(objects.filter(heading == ""), ERROR, "CONS001", F.col(ident), F.lit("no heading")),
            finding(objects.filter((heading != "") & (heading != F.col("title"))), ERROR, "CONS002", F.col(ident), F.concat(F.lit("the heading is "), heading)),
            finding(objects.filter(n > (F.lit(limit) if isinstance(limit, int) else limit)), ERROR, "COPY001", F.col(ident), F.concat(n.cast("string"), F.lit(" words"))),
        ]
    )


def registry(objects: DataFrame, paths: DataFrame, ident: str = "id") -> DataFrame:
    """REG003-005: objects (id, path) that the registry (id, path) lacks or has elsewhere, and entries without an object."""
    both = objects.select(ident, F.col("path").alias("own")).join(paths.select(ident, F.col("path").alias("registered")), ident, "full_outer")
    return union(
        [
            finding(both.filter("own is not null and registered is null"), ERROR, "REG003", F.col(ident), F.lit("not registered")),
            finding(both.filter("own <> registered"), ERROR, "REG004", F.col(ident), F.concat(F.lit("registered at "), F.col("registered"))),
            finding(both.filter("own is null"), WARNING, "REG005", F.col(ident), F.lit("registered, but not there")),
        ]
    )


def registry_counters(used: DataFrame, counters: DataFrame) -> DataFrame:
    """REG002: months whose counter (month_key, counter) is below the highest number in use (month_key, sequence)."""
    highest = used.groupBy("month_key").agg(F.max("sequence").alias("used"))
    low = highest.join(counters, "month_key", "left").filter(F.coalesce("counter", F.lit(0)) < F.col("used"))
    return finding(low, ERROR, "REG002", F.col("month_key"), F.concat(F.lit("number "), F.col("used").cast("string"), F.lit(" is in use")))


def baseline_match(runs: DataFrame, accepted: DataFrame, keys: list[str], location: Column) -> DataFrame:
    """REV002 and REV003: runs are warnings, information where all of `keys` are those of an accepted one; accepted ones that are no more are stale."""
    known = accepted.select(*keys).distinct().withColumn("known", F.lit(True))
    marked = runs.join(known, keys, "left")
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    level = F.when(F.col("known"), INFO).otherwise(WARNING)
    rows = marked.select(level.alias("level"), F.lit("REV002").alias("code"), location.cast("string").alias("location"), text.alias("message"))
    return rows.unionByName(finding(accepted.join(runs.select(*keys), keys, "left_anti"), WARNING, "REV003", location, text))
