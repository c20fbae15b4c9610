"""Exact deduplication by content sort.

Sampled splitters range-partition the documents by their normalised text (its first characters, then a hash
that keeps common openings apart); each partition is sorted externally by the whole normalised text, so equal
texts are adjacent, and a window compares each full text with its neighbour's. Of a run of equals, the row with
the longest original text stays, then the smallest identifier. DataFrame operations only.

Texts with very many copies are dealt over several runs: a first pass counts copies by hash; those above
1/65,536 of all rows (so at most 65,536 texts, the bound of what is broadcast) get as many salts as keep a run
below that. The heads of such runs, one row for each run, are then merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, materialize, prefix, quoted, shuffle_partitions

#: At most this many texts count as heavy, whatever the input.
HEAVY = 65_536
#: A run of so few equal rows is never split.
RUN = 256


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", "")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. With carry: the rows that stay, in docs' columns.

    Null text counts as empty and equals texts of white space only. A null identifier sorts last. Of rows that repeat
    text and identifier, one stays. Extra columns are ignored, or passed on with carry. No rows give no rows.
    """
    p = prefix(docs)
    ident, text = quoted([id_col, text_col])
    c = {x: F.col(p + x) for x in ("h", "n", "salts", "salt", "norm", "len", "rn", "keep", "sha", "best", "all")}
    rows = docs if carry else docs.select(ident, text)
    copies = rows.select(F.xxhash64(normalised(text)).alias(p + "h")).groupBy(p + "h").agg(F.count("*").alias(p + "n"))
    copies = copies.filter(c["n"] > RUN)
    most = max(RUN, docs.count() // HEAVY)
    heavy = copies.filter(c["n"] > most).select(p + "h", F.ceil(c["n"] / most).alias(p + "salts"))
    keyed = rows.withColumn(p + "norm", normalised(text))
    keyed = keyed.withColumns({p + "pre": F.substring(p + "norm", 1, 24), p + "h": F.xxhash64(p + "norm")}).drop(p + "norm")
    keyed = keyed.join(F.broadcast(heavy), p + "h", "left")
    keyed = keyed.withColumn(p + "salt", F.pmod(F.xxhash64(ident), F.coalesce(c["salts"], F.lit(1))))
    ranged = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), p + "pre", p + "h", p + "salt")
    ranged = ranged.withColumns({p + "norm": normalised(text), p + "len": F.length(F.coalesce(text, F.lit("")))})
    run = Window.partitionBy(p + "pre", p + "h", p + "salt", p + "norm").orderBy(c["len"].desc(), ident.asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = ranged.withColumns({p + "rn": F.row_number().over(run), p + "keep": F.first(ident).over(whole), p + "n": F.count("*").over(whole)})
    heads = heads.withColumn(p + "sha", F.sha2(p + "norm", 256))
    drop = [p + "norm", p + "pre", p + "h"]
    first = F.struct((-c["len"]).alias("l"), c["keep"].isNull().alias("z"), c["keep"].alias("k"), c["salt"].alias("s"))
    if carry:
        # Nothing is written: the heads of split runs are found by one more pass over the heavy texts, if there are any.
        one = heads.filter(c["rn"] == 1).drop(*drop)
        if heavy.isEmpty():
            return one.select(*quoted(docs.columns))
        split = keyed.filter(c["salts"].isNotNull()).withColumns({p + "sha": F.sha2(normalised(text), 256), p + "len": F.length(F.coalesce(text, F.lit(""))), p + "keep": ident})
        split = split.groupBy(p + "sha").agg(F.min(first).alias(p + "best"))
        merged = one.join(F.broadcast(split), p + "sha", "left")
        return merged.filter(c["best"].isNull() | (c["best"]["s"] == c["salt"])).select(*quoted(docs.columns))
    runs = materialize(heads.drop(*drop, text_col), "content-sort")
    split = runs.filter(c["salts"].isNotNull() & (c["rn"] == 1)).groupBy(p + "sha").agg(F.min(first).alias(p + "best"), F.sum(p + "n").alias(p + "all"))
    merged = runs.join(F.broadcast(split), p + "sha", "left")
    kept = (c["rn"] == 1) & (c["best"].isNull() | (c["best"]["s"] == c["salt"]))
    keep_id = F.when(c["best"].isNull(), c["keep"]).otherwise(c["best"]["k"])
    return merged.select(ident.alias("doc_id"), keep_id.alias("keep_id"), F.coalesce(c["all"], c["n"]).alias("group_size"), kept.alias("kept"), c["sha"].alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST)
"""
