"""Permanent identifiers: numbers in order within a collection and month, after those already given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import format_id
from ..plans.shared import written


def item_order(published: str = "published_date", key: str = "identity_key") -> list[Column]:
    """The order in which items are taken: by date, undated ones last, then by key."""
    return [F.col(published).asc_nulls_last(), F.col(key).asc()]


def mint(items: DataFrame, counters: DataFrame, prefix: str = "prefix", published: str = "published_date", first_seen: str = "first_seen", key: str = "identity_key") -> DataFrame:
    """items with month_key, sequence and id.

    The month is that of the published date, else of the day the item was first seen, however late it was approved.
    counters: (prefix, month_key, counter), the last number given; months without one start at 1.

    Items are dealt to ranges of their order over all months, so that a month of any size is many tasks' work. A number is
    the place within its range, after the items that earlier ranges have of the month.
    """
    month = F.coalesce(published, first_seen)
    dated = items.withColumn("month_key", F.date_format(month, "yyyy-MM"))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = item_order(published, key)
    # Written, so that every later step sees the same ranges.
    ranged = written(dated.repartitionByRange(n, F.col(prefix), F.col("month_key"), *order).withColumn("range", F.spark_partition_id()), "mint-ranges")
    group = [prefix, "month_key"]
    sizes = ranged.groupBy(*group, "range").agg(F.count("*").alias("size"))
    upto = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows of a month
    start = sizes.join(counters, group, "left").select(*group, "range", (F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.coalesce("counter", F.lit(0))).alias("start"))
    turn = F.row_number().over(Window.partitionBy("range", *group).orderBy(*order))
    numbered = ranged.withColumn("turn", turn).join(start, ["range", *group]).withColumn("sequence", F.col("turn") + F.col("start"))
    return numbered.withColumn("id", format_id(F.col(prefix), F.substring("month_key", 1, 4), F.substring("month_key", 6, 2), F.col("sequence"))).drop("turn", "start", "range")


def counters_after(minted: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(prefix, month_key, counter) to go on from."""
    return minted.groupBy(prefix, "month_key").agg(F.max("sequence").alias("counter"))
