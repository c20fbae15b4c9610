"""The registry of identifiers: where each object lies, and the last number of each collection and month, in one versioned table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import parse_id
from .snapshots import Table

PATHS = "id string, path string, run_id string, pack string"
COUNTERS = "pack string, month_key string, counter long"


class Registry:
    """Identifiers are recorded before their objects are stored, and never taken back: what a run that died has recorded is not given out again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Table(spark, f"{root}/registry", PATHS, ("pack",))

    def exists(self) -> bool:
        return self.table.version().number > 0

    def paths(self) -> DataFrame:
        """(id, path, run_id, pack) of all that has been recorded."""
        return self.table.read()

    def counters(self) -> DataFrame:
        """(pack, month_key, counter)."""
        return self.spark.createDataFrame([tuple(r) for r in self.table.version().notes.get("counters", [])], COUNTERS)

    def record(self, objects: DataFrame, run_id: str) -> None:
        """Record objects (id, pack) that are not recorded yet, and move the counters, in one step. Another writer's commit meanwhile is a Conflict."""
        base = self.table.version()
        known = self.table.read(base, [(r[0],) for r in objects.select("pack").distinct().collect()])
        new = objects.select("id", "pack").join(known.select("id"), "id", "left_anti").withColumn("p", parse_id(F.col("id")))
        parts = self.table.stage(new.select("id", F.col("p.subpath").alias("path"), F.lit(run_id).alias("run_id"), "pack"))
        if not parts:
            return
        last = {(p, m): n for p, m, n in base.notes.get("counters", [])}
        used = objects.withColumn("p", parse_id(F.col("id"))).filter("p is not null").groupBy("pack", "p.month_key").agg(F.max("p.sequence").alias("n"))
        for r in used.collect():  # collections times months
            last[r.pack, r.month_key] = max(r.n, last.get((r.pack, r.month_key), 0))
        self.table.commit(base, parts, notes={"counters": [[*k, n] for k, n in sorted(last.items())]}, reads=True)

    def damage(self) -> str | None:
        """Why the registry cannot be read; None where it can."""
        try:
            self.counters().count()
        except (json.JSONDecodeError, KeyError, TypeError, ValueError) as e:
            return f"{type(e).__name__}: {e}"
        return None if self.exists() else "there is none"
