"""Objects as a folder of documents: one YAML file of metadata and one article for each, by year and month.

Files are listed and read by Spark, so a folder may lie in any store; each is parsed by itself, and what cannot be parsed is
a row that says why instead of the end of the scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OBJECT_COLUMNS, OBJECTS
from .paths import ARTIFACT_FOLDERS

METADATA, ARTICLE = "metadata.yaml", "article.md"
#: Where an object's folder lies within a collection: knowledge/yyyy/mm/name.
LAYOUT = r"^(.*)/([^/]+)/knowledge/(\d{4}/\d{2}/[^/]+)/([^/]+)$"
FILES = "pack string, path string, name string, value string"


def read_files(spark: SparkSession, root: str, name: str = METADATA) -> DataFrame:
    """pack, path (yyyy/mm/folder), name and value of each file of that name in the collections under root (`*/knowledge/yyyy/mm/folder`); none where there are none."""
    try:
        files = spark.read.text(f"{root}/*/knowledge/*/*/*/{name}", wholetext=True)
    except Exception as e:  # Spark tells a glob without files by an exception
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FILES)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), LAYOUT, k)
    return files.select(part(2).alias("pack"), part(3).alias("path"), part(4).alias("name"), "value")


def _plain(value):
    """A YAML value as JSON holds it."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def parse_metadata(text: str) -> tuple[str | None, str | None]:
    """A YAML document as JSON, or what is wrong with it."""
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return None, f"no YAML: {str(e).splitlines()[0]}"
    return (json.dumps(_plain(found)), None) if isinstance(found, dict) else (None, "no mapping")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """pack, path, error (null of a readable document), keys (of the document) and document (a struct of OBJECT_COLUMNS) of each metadata document under root, malformed ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_metadata(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e for _, e in found], pa.string()), pa.array([j for j, _ in found], pa.string())], names=["pack", "path", "error", "json"])

    rows = read_files(spark, root).select("pack", "path", "value").mapInArrow(run, "pack string, path string, error string, json string")
    keys = F.json_object_keys("json")
    return rows.select("pack", "path", "error", keys.alias("keys"), F.from_json("json", OBJECTS, {"mode": "PERMISSIVE"}).alias("document"))


def objects(scanned: DataFrame) -> DataFrame:
    """The stored form (OBJECT_COLUMNS and pack) of scan()'s readable documents, in order of path."""
    return scanned.filter("error is null").orderBy("pack", "path").select("document.*", "pack")


def presence(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """pack, path, has_metadata, has_article and is_mapping of each object folder under root: what validate.object_files() checks."""
    articles = read_files(spark, root, ARTICLE).select("pack", "path").withColumn("has_article", F.lit(True))
    both = scanned.select("pack", "path", F.lit(True).alias("has_metadata"), F.col("error").isNull().alias("is_mapping")).join(articles, ["pack", "path"], "full_outer")
    return both.select("pack", "path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_metadata", "has_article", "is_mapping")])


def artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """pack, folder (yyyy/mm/name) and file (its path below that) of every file in objects' artifact folders. Listed, not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/knowledge/*/*/*/{{{','.join(ARTIFACT_FOLDERS)}}}").select("path")
    except Exception as e:  # Spark tells a glob without files by an exception
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "pack string, folder string, file string")
    part = lambda k: F.regexp_extract("path", r"^(.*)/([^/]+)/knowledge/(\d{4}/\d{2}/[^/]+)/(.+)$", k)
    return files.select(part(2).alias("pack"), part(3).alias("folder"), part(4).alias("file"))


def _scalar(value: Column) -> Column:
    """A JSON string is a YAML scalar, so quoting is JSON's; null is null."""
    return F.coalesce(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("null"))


def rendered(rows: DataFrame) -> Column:
    """An object as a YAML document: its columns in the fixed order, one to a line, lists and structs in YAML's flow style; no anchors."""
    lines = []
    for name in OBJECT_COLUMNS:
        kind = rows.schema[name].dataType.typeName()
        nested = kind in ("array", "struct", "map")
        value = F.coalesce(F.to_json(F.col(name), {"ignoreNullFields": "false"}), F.lit("null")) if nested else _scalar(F.col(name))
        lines.append(F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def export(rows: DataFrame, path: str) -> None:
    """Write one folder of text for each object, `pack=.../id=.../part-*`, with its YAML document."""
    rows.select("pack", "id", rendered(rows).alias("value")).write.mode("overwrite").partitionBy("pack", "id").text(path)
