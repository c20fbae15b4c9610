"""Connected components of a table of links, by alternating star contraction (large star, then small star).

A round sends every node's larger neighbours to its smallest one, then its smaller ones; the number of rounds grows
with the logarithm of the longest chain. Minima come from aggregates with partial sums and are written before the links
are joined to them, so that Spark broadcasts them where they are few, and otherwise can split the links of a node that
has very many. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """One half round over links (u > v), written."""
    if both:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    least = materialize(least, "least")
    met = sides.join(least, F.col("u") == F.col("k"))
    if both:
        stars = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        to_least = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = to_least.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    stars = materialize(stars.distinct(), "links")
    forget(least)
    forget(links)
    return stars


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): of `links` (u, v: long), every node that has a link to another, and the smallest node it reaches.

    Links of a node to itself, repeated links and links with a null end are ignored. No links give no rows.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        links = _stars(_stars(links, True), False)
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
