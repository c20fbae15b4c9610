"""The weekly digest of a run, and review tasks collection by collection, as documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_week
from ..operators import coverage, crosspack, digest, retrieve, review
from ..sources import store

LINE = "pack string, week string, line string"


def tasks_of(objects: DataFrame, groups: DataFrame, queues: dict[str, DataFrame]) -> DataFrame:
    """review.tasks() with pack: what waits in each collection's queue, its flagged objects, and the groups that it is part of."""
    basis = {"url": "url_hash", "content": "content_hash"}
    each = []
    for pack, queue in queues.items():  # collections are configuration
        mine = objects.filter(F.col("pack") == pack)
        found = review.tasks([review.flagged(mine), review.shared(crosspack.involving(groups, objects, pack, basis)), review.queued(queue)])
        each.append(found.withColumn("pack", F.lit(pack)))
    return reduce(DataFrame.unionByName, each)


def digest_of_run(run, report: dict[str, int], stored: DataFrame, new: DataFrame, updated: DataFrame, decisions: DataFrame, queue: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """digest.digest_lines() of one run of one collection, from what it did: new and updated objects, what failed, what waits."""
    spark: SparkSession = stored.sparkSession
    week = spark.range(1).select(iso_week(F.lit(run.today))).first()[0]
    at = lambda df: df.select(F.lit(run.pack).alias("pack"), F.lit(week).alias("week"), "*")
    none = spark.createDataFrame([], LINE)
    same = report.get("verdict_known-identity", 0) - report["updated"]
    numbers = (run.pack, week, run.run_id, report["items"], report["updated"], max(0, same), report["queued"], report["classified"])
    runs = spark.createDataFrame([numbers], "pack string, week string, run_id string, discovered long, updated long, unchanged long, queued long, classified long")
    failed = none if attempts is None else at(attempts.filter("not ok").select(F.concat_ws(": ", "name", "reason").alias("line")))
    errors = spark.createDataFrame([(run.pack, week, f"{report['errors']} items made no valid object")] if report["errors"] else [], LINE)
    near = decisions.filter("verdict = 'near-duplicate'").select(F.concat(F.col("title"), F.lit(" is like "), F.col("matched")).alias("line"))
    waiting = review.counts(review.tasks([review.flagged(stored), review.queued(queue)]))
    rows = coverage.artifact_rows(stored, retrieve.current_revision(F.col("revisions")))
    made = rows.agg(F.count(F.when(F.col("behind").isNotNull(), 1)).alias("stale"), F.count(F.when(F.col("status") == "requested", 1)).alias("requested"))
    changed = updated.select(F.concat_ws(" | ", "id", "title").alias("line"))
    return digest.digest_lines(runs, at(new.select("id", "tier", "title")), failed, errors, at(near), at(changed), at(waiting), at(made))


def write_digest(lines: DataFrame, root: str) -> None:
    """Under root/digests, a folder for each collection and week; a later run of the week replaces its digest."""
    store.write_documents(lines, f"{root}/digests", ("pack", "week"), ("section", "place"))
