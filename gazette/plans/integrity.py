"""All integrity rules over a store, its collections' configuration and their folders of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import parse_id
from ..operators import crosspack, history, validate
from ..schema import OBJECT_COLUMNS, PROPOSED, SCHEMA_VERSION, VOCABULARIES
from ..sources import documents, packs, store
from ..sources.paths import links_outside
from ..sources.registry import Registry
from .shared import local_path, written

ACKNOWLEDGED = "ids string, basis string, acknowledged_on date"
BASELINE = "id string, fields string, first_revision int, last_revision int, accepted_on date"
RUN_KEYS = ["id", "fields", "first_revision", "last_revision"]
REFERENCES = ["prerequisites", "builds_on", "related_topics", "replaced_by", "replaces"]


def repeated(objects: DataFrame) -> DataFrame:
    """(id, fields, first_revision, last_revision): REV002's runs. Fields are sorted here, so that no caller has to."""
    rows = history.exploded(objects).withColumn("changed_fields", F.array_join(F.array_sort("changed_fields"), ","))
    runs = history.repeated_runs(rows)
    return runs.select("id", "fields", F.col("first_revision").cast("int").alias("first_revision"), F.col("last_revision").cast("int").alias("last_revision"))


def read_baseline(spark: SparkSession, root: str) -> DataFrame:
    return store.read_state(spark, f"{root}/baseline", BASELINE)


def accept(objects: DataFrame, root: str, today: Column) -> int:
    """Take the runs that are there now into the baseline; those that are in it keep their day. How many are new."""
    known = read_baseline(objects.sparkSession, root)
    new = written(repeated(objects).join(known.select(*RUN_KEYS), RUN_KEYS, "left_anti").withColumn("accepted_on", today.cast("date")), "baseline")
    store.write_state(known.unionByName(new.select(*known.columns)), f"{root}/baseline", "id")
    return new.count()


def stored_findings(objects: DataFrame, acknowledged: DataFrame, baseline: DataFrame) -> DataFrame:
    """The rules that the stored objects alone are held against: SCHEMA001 and 003, ID003, OWN, REF001, XPK001, REV001 to 003."""
    lost = crosspack.dangling(objects, objects.select("id"), REFERENCES)
    chain = history.chain_problems(history.exploded(objects), objects.select("id", "content_hash"))
    return validate.union(
        [
            *[validate.vocabulary(objects, column, allowed) for column, allowed in VOCABULARIES.items()],
            validate.duplicate_ids(objects, "id", ["pack"]),
            validate.schema_version(objects, (SCHEMA_VERSION,)),
            validate.overrides(objects, list(PROPOSED), list(OBJECT_COLUMNS)),
            validate.references(lost, objects.select("pack").distinct().count()),
            validate.duplicates(crosspack.duplicate_groups(objects), acknowledged),
            validate.finding(chain, validate.ERROR, "REV001", F.col("id"), F.concat_ws(" ", "problem", "revision")),
            validate.baseline_match(repeated(objects), baseline, RUN_KEYS, F.col("id")),
        ]
    )


def registry_findings(objects: DataFrame, registry: Registry) -> DataFrame:
    """REG001 to REG005, collection by collection; a registry that cannot be read, or is not there, is that finding alone."""
    spark = objects.sparkSession
    damage = registry.damage()
    if damage:
        return validate.registry_readable(spark.createDataFrame([("registry", damage)], "pack string, error string"))
    parsed = objects.withColumn("p", parse_id(F.col("id"))).filter("p is not null")
    both = validate.registry(parsed.select("id", F.col("p.subpath").alias("path")), registry.paths())
    at = F.concat_ws("/", "pack", "month_key").alias("month_key")
    used = parsed.select("pack", "p.month_key", "p.sequence").select(at, "sequence")
    return both.unionByName(validate.registry_counters(used, registry.counters().select(at, "counter")))


def pack_findings(configs: DataFrame, sources: DataFrame, objects: DataFrame, registry: Registry, only: list[str]) -> DataFrame:
    """PACK000 to PACK005, SEC002 and SCHEMA005: of configs as packs.read_configs() has them."""
    readable = configs.filter("error is null")
    declared = readable.select("pack", F.explode("categories").alias("category"))
    stated = registry.paths().select("pack").distinct() if registry.damage() is None else configs.select("pack").limit(0)
    # A collection that declares no categories leaves them open.
    closed = objects.join(declared.select("pack").distinct(), "pack", "left_semi")
    named = lambda df: df.withColumn("category", F.concat_ws("/", "pack", "category"))
    undeclared = validate.undeclared_category(named(closed.filter("category is not null")), named(declared))
    return validate.union(
        [
            validate.pack_exists(configs, only),
            validate.pack_config(readable),
            validate.pack_state(readable, stated),
            validate.unloadable(configs),
            validate.source_urls(sources),
            undeclared,
        ]
    )


def document_findings(spark: SparkSession, root: str, configs: DataFrame) -> DataFrame:
    """SEC001, OBJ001 to OBJ004, ID001, ID002, ID004, SCHEMA002 and 004, GEN, CONS and COPY001, of collections' folders of documents under root.

    Identifiers are held against the folder that they are found in and the prefix of that collection's configuration, articles
    against its limit. Artifacts are files below their object's own folder.
    """
    scanned = written(documents.scan(spark, root), "scanned")
    good = scanned.filter("error is null").select("pack", "path", "keys", "document.*")
    config = configs.filter("error is null").select("pack", F.col("id_prefix").alias("prefix"), "max_summary_words")
    placed = good.join(config, "pack")
    bodies = documents.read_files(spark, root, documents.ARTICLE).select("pack", "path", F.col("value").alias("body"))
    articles = placed.join(bodies, ["pack", "path"])
    files = documents.artifact_files(spark, root)
    owned = good.select("pack", F.col("path").alias("folder"), "id").join(files, ["pack", "folder"]).select("id", F.col("file").alias("path"))
    links = spark.createDataFrame(links_outside(local_path(root)), "path string, target string")
    return validate.union(
        [
            validate.escaping_links(links),
            validate.object_files(documents.presence(spark, root, scanned)),
            validate.identifiers(placed.filter("id is not null")),
            validate.schema_keys(good, F.col("keys"), list(OBJECT_COLUMNS), F.col("path")),
            validate.artifacts(good, owned),
            validate.article(articles, F.col("max_summary_words")),
        ]
    )


def findings(spark: SparkSession, root: str, packs_root: str | None = None, documents_root: str | None = None, only: list[str] | None = None) -> DataFrame:
    """(level, code, location, message) of every rule. Configuration and documents are held against theirs where their folders are given."""
    objects = store.read_objects(spark, f"{root}/objects")
    acknowledged = store.read_state(spark, f"{root}/acknowledged", ACKNOWLEDGED, "empty")
    registry = Registry(spark, root)
    parts = [stored_findings(objects, acknowledged, read_baseline(spark, root))]
    if not objects.isEmpty() or registry.exists():
        parts.append(registry_findings(objects, registry))
    if packs_root:
        configs, sources = packs.read_configs(spark, packs_root)
        parts.append(pack_findings(configs, sources, objects, registry, only or []))
        if documents_root:
            parts.append(document_findings(spark, documents_root, configs))
    return validate.union(parts)

