"""The store: objects by pack and month and state tables, both with versions, and the lock of a single writer."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import parse_id
from ..operators.updates import guard_ownership
from ..schema import OBJECTS, PROPOSED, USER_OWNED
from .snapshots import Table

PARTITIONS = ("pack", "id_year", "id_month")
STALE_LOCK_S = 3600


class StoreError(RuntimeError):
    pass


def _placed(objects: DataFrame) -> DataFrame:
    parsed = parse_id(F.col("id"))
    return objects.withColumns({"id_year": parsed["year"], "id_month": parsed["month"]})


def objects_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, f"{OBJECTS}, pack string, id_year int, id_month int", PARTITIONS)


def read_objects(spark: SparkSession, path: str, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """All stored objects of the last version, or of one by its number or its time; none where nothing has been written. The version is pinned: later changes do not reach what has been read."""
    table = objects_table(spark, path)
    return table.read(table.version(version, as_of))


def read_object(spark: SparkSession, path: str, ident: str, pack: str) -> DataFrame:
    """One object: the partition of its pack and month is all that is read."""
    _, year, month, _ = ident.split("-")
    return objects_table(spark, path).read(only=[(pack, int(year), int(month))]).filter(F.col("id") == ident)


def _partitions(objects: DataFrame) -> list[tuple]:
    """The partitions that objects fall into; a collection has twelve a year."""
    return [tuple(r) for r in objects.select(*PARTITIONS).distinct().collect()]


def insert_objects(objects: DataFrame, path: str) -> None:
    """Append new objects (with pack). One that is stored already, in any pack, or comes twice, is an error, and nothing is written. Only months of the new objects are read."""
    table = objects_table(objects.sparkSession, path)
    objects = _placed(objects)
    base = table.version()
    months = {p[1:] for p in _partitions(objects)}
    stored = [v for v in base.values() if v[1:] in months]
    ids = table.read(base, stored).select("id").unionByName(objects.select("id"))
    again = objects.select("id").join(ids.groupBy("id").count().filter("count > 1"), "id", "left_semi").limit(1).collect()
    if again:
        raise StoreError(f"{again[0][0]} is stored already")
    table.commit(base, table.stage(objects), reads=stored)


def update_objects(changed: DataFrame, path: str, by_user: bool = False) -> bool:
    """Put changed objects in place of the stored ones. Partitions without a change keep their files; whether anything was written.

    Columns that users own, or have locked, may not differ from what is stored, unless it is a user who asks for it. Objects that are not stored are added.
    """
    table = objects_table(changed.sparkSession, path)
    changed = _placed(changed)
    base = table.version()
    stored = table.read(base, _partitions(changed))
    columns = [c for c in stored.columns if c != "id"]
    comparable = lambda df: df.select("id", F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in columns]))).alias("h"))
    differs = comparable(changed).join(comparable(stored), ["id", "h"], "left_anti").select("id")
    changed = changed.join(differs, "id", "left_semi")
    touched = _partitions(changed)
    if not touched:
        return False
    stored = table.read(base, touched)
    if not by_user:
        changed = guard_ownership(stored, changed, "id", list(USER_OWNED), list(PROPOSED))
    rest = stored.join(changed.select("id"), "id", "left_anti")
    table.commit(base, table.stage(rest.unionByName(changed.select(*stored.columns))), touched)
    return True


def write_documents(lines: DataFrame, path: str, by: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Write lines (by..., order..., line) as text, a folder for each value of `by` with its lines in order; only those folders are replaced."""
    dealt = lines.repartition(*by).sortWithinPartitions(*by, *order).select(*by, F.col("line").alias("value"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)


def write_state(table: DataFrame, path: str, key: str, batch: tuple[str, int] | None = None) -> None:
    """A state table in place of what it was, as one version. Each task's rows are in order of the key. What is replaced may be what it was made from."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    Table(table.sparkSession, path, schema).overwrite(table.sortWithinPartitions(key), batch)


def read_state(spark: SparkSession, path: str, schema: str, damaged: str = "raise", version: int | None = None) -> DataFrame:
    """A state table; empty where there is none. damaged: `raise` for what cannot be lost, `empty` for what can be built again."""
    table = Table(spark, path, schema)
    try:
        return table.read(table.version(version))
    except (json.JSONDecodeError, KeyError, TypeError, AnalysisException) as e:
        if damaged == "raise":
            raise StoreError(f"{path} is damaged") from e
        return spark.createDataFrame([], schema)


def append_run_log(spark: SparkSession, path: str, row: dict) -> None:
    """One more row, also of a run that did nothing."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True, default=str),)], "run string").write.mode("append").json(path)


@contextmanager
def pack_lock(path: str, now=time.time):
    """Held by one process at a time; one that is older than an hour is taken over."""
    if os.path.exists(path) and now() - os.path.getmtime(path) > STALE_LOCK_S:
        os.unlink(path)
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise StoreError(f"another run holds {path}") from None
    try:
        with os.fdopen(handle, "w") as f:
            f.write(str(os.getpid()))
        yield
    finally:
        os.unlink(path)
