"""What an item is: its identity, how far that can be trusted, and whether it may be stored without a person's look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

DURABLE = ("canonical-url", "source-identifier")
LEVELS = ("high", "medium", "low")


def resolve(url: Column, source_id: Column, title: Column, summary: Column) -> Column:
    """A struct of basis, key and raw_value: the first that there is of URL, source's identifier, normalised title, text. Null if there is none."""

    def of(basis: str, raw: Column) -> Column:
        return F.when(F.coalesce(raw, F.lit("")) != "", F.struct(F.lit(basis).alias("basis"), tx.digest(raw).alias("key"), raw.alias("raw_value")))

    said = tx.single_line(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    return F.coalesce(of("canonical-url", url), of("source-identifier", source_id), of("normalised-title-hash", tx.normalise_title(title)), of("content-fingerprint", said))


def census(items: DataFrame, key: str = "identity_key", title: str = "title") -> DataFrame:
    """(key, features): how many titles claim an identity, wordings apart."""
    return items.groupBy(key).agg(F.count_distinct(tx.normalise_title(F.col(title))).alias("features"))


def collisions(items: DataFrame, order: str, key: str = "identity_key", title: str = "title") -> DataFrame:
    """(key, features, titles) of identities that several titles claim, the most first; of each wording, the earliest title."""
    named = items.withColumn("wording", tx.normalise_title(F.col(title)))
    first = named.groupBy(key, "wording").agg(F.min_by(title, order).alias("published"))
    found = first.groupBy(key).agg(F.count("*").alias("features"), F.array_sort(F.collect_list("published")).alias("titles"))
    return found.filter("features > 1").orderBy(F.desc("features"), key)


def grade(items: DataFrame, key: str = "identity_key", basis: str = "identity_basis", title: str = "title") -> DataFrame:
    """items with features, identity_confidence and confidence_reason."""
    graded = items.join(census(items, key, title), key, "left")
    b, nothing = F.col(basis), tx.normalise_title(F.col(title)) == ""
    durable = b.isin(*DURABLE)
    shared = F.col("features") > 1
    level = (
        F.when(b == "content-fingerprint", "low").when(nothing & ~durable, "low").when(~durable, "medium").when(shared, "medium").otherwise("high")
    )
    reason = (
        F.when(b == "content-fingerprint", "the text is all there is to identify it by, and texts change")
        .when(nothing & ~durable, "neither a durable anchor nor a title of its own")
        .when(~durable, F.concat(F.lit("a "), b, F.lit(" does not survive rewording, and there is no URL")))
        .when(shared, F.concat(F.lit("its announcement is that of "), F.col("features").cast("string"), F.lit(" features")))
        .otherwise(F.concat(F.lit("a durable anchor ("), b, F.lit(") of this feature alone")))
    )
    return graded.withColumns({"identity_confidence": level, "confidence_reason": reason})


def gate(graded: DataFrame, authority: str = "source_authority", official: tuple[str, ...] = ("official",)) -> DataFrame:
    """graded with lifecycle: approved where confidence is high and the source official, else queued."""
    passes = (F.col("identity_confidence") == "high") & F.col(authority).isin(*official)
    return graded.withColumn("lifecycle", F.when(passes, "approved").otherwise("queued"))


def confidence_tally(graded: DataFrame) -> DataFrame:
    """(identity_confidence, items), a row for each level, zeros included."""
    levels = graded.sparkSession.createDataFrame([(x,) for x in LEVELS], "identity_confidence string")
    counts = graded.groupBy("identity_confidence").agg(F.count("*").alias("n"))
    return levels.join(counts, "identity_confidence", "left").select("identity_confidence", F.coalesce("n", F.lit(0)).alias("items"))


def scheme_evaluation(items: DataFrame, schemes: dict[str, list[Column]], side: str, title: str = "title") -> DataFrame:
    """For each way to identify items: features told apart, how many both renderings (`side`: 0 or 1) share in percent, and identities that merge several titles, with how many are lost so."""
    rows = None
    for name, columns in schemes.items():
        key = F.concat_ws("\u0001", *columns)
        per = items.groupBy(key.alias("k")).agg(F.count_distinct(title).alias("titles"), F.max(F.col(side) == 0).alias("in0"), F.max(F.col(side) == 1).alias("in1"))
        one = per.agg(
            F.count("*").alias("features"),
            F.floor(100 * F.sum((F.col("in0") & F.col("in1")).cast("int")) / F.count("*")).alias("agreement"),
            F.sum((F.col("titles") > 1).cast("int")).alias("merged"),
            F.sum(F.greatest(F.col("titles") - 1, F.lit(0))).alias("lost"),
        ).withColumn("scheme", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows
