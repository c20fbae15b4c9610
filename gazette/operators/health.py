"""Sources' health from their attempts, as batch queries. streaming/health.py keeps the same state over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Successful counts that the baseline looks back on, and that it needs at least.
HISTORY, LEAST = 26, 3
#: A yield below this share of the baseline looks like a broken parser.
BREAK = 0.34
#: Failures in a row that want an alert.
ALERT = 3


def baseline(attempts: DataFrame, source: str, order: list[str], ok: Column, items: str) -> DataFrame:
    """(source, observations, baseline): the median of the last HISTORY successful counts; null below LEAST of them."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*[F.desc(c) for c in order]))
    last = attempts.filter(ok).withColumn("turn", turn).filter(F.col("turn") <= HISTORY)
    found = last.groupBy(source).agg(F.count("*").alias("observations"), F.median(items).alias("median"))
    return found.select(source, "observations", F.when(F.col("observations") >= LEAST, F.col("median")).alias("baseline"))


def failure_streak(attempts: DataFrame, source: str, order: list[str], ok: Column) -> DataFrame:
    """(source, streak, needs_alert): failures since the last success."""
    at = F.struct(*order)
    marked = attempts.withColumns({"at": at, "ok": ok})
    last = marked.groupBy(source).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    met = marked.join(last, source)
    streak = F.sum((~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).cast("int"))
    return met.groupBy(source).agg(streak.alias("streak")).withColumn("needs_alert", F.col("streak") >= ALERT)


def looks_broken(items: Column, base: Column) -> Column:
    return F.coalesce((base > 0) & (items < base * BREAK), F.lit(False))


def states(attempts: DataFrame, source: str, order: list[str], ok: Column, items: str, primary: Column) -> DataFrame:
    """(source, state, streak, last_items): failed, degraded (a fallback, or a yield that looks broken) or healthy, by the last attempt."""
    back = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    rows = attempts.withColumns({"ok": ok, "primary": primary, "turn": F.row_number().over(back)})
    last = rows.filter("turn = 1")
    base = baseline(rows.filter("turn > 1"), source, order, F.col("ok"), items).select(source, "baseline")
    joined = last.join(base, source, "left").join(failure_streak(attempts, source, order, ok).select(source, "streak"), source)
    degraded = ~F.col("primary") | looks_broken(F.col(items), F.col("baseline"))
    state = F.when(~F.col("ok"), "failed").when(degraded, "degraded").otherwise("healthy")
    return joined.select(source, state.alias("state"), "streak", F.when(F.col("ok"), F.col(items)).otherwise(0).alias("last_items"))


def failed_sources(attempts: DataFrame, source: str, ok: Column) -> DataFrame:
    """The sources with an attempt that failed, each once."""
    return attempts.filter(~ok).select(source).distinct()
