"""Mixing sources to target weights.

Each row gets a hash-random key; within its source, rows are in order of that key, dealt over ranges of it. A prefix
sum over the ranges' totals (few rows) and one within each range give every row its place in its source's sequence of
words, and each source is cut at its exact budget, after as many whole epochs as the budget holds. DataFrame
operations only. The sizes of texts are written once, and all sums run over those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prefix, quoted, words

#: Rows that one range of keys should hold; a range is one task's work.
RANGE_ROWS = 50_000
#: log2 of the ranges that a source has at least, so that one which holds most of a small table is many tasks' work.
LEAST_BITS = 8


def source_targets(sized: DataFrame, source: str, size: str, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size and target, a row for each source: `weights` repeat over the sources in code point order, null last.

    The targets share `share` times all sizes by weight, but none is above `most` times its source's size. With the
    sources in order of size / weight, the first few are at that limit and all others share what is left at one level;
    the first whose limit is above its own level sets it. A source without words has target 0.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    # These windows order the list of sources, one row each, never rows of the corpus.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (rank % len(weights) + 1).cast("int")))
    full = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "left_w": F.sum("w").over(after),
            "total": F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", (share * F.col("total") - most * F.col("capped")) / F.col("left_w"))
    free = most * F.col("source_size") >= F.col("level") * F.col("w")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("at", level)
    target = F.when(F.col("at").isNull(), most * F.col("source_size")).otherwise(F.col("at") * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: bool, kw: dict) -> tuple[DataFrame, str]:
    """docs (without carry, the identifier alone) with size, source_size, target and taken, named with the prefix returned."""
    p = prefix(docs)
    ident, text, source = quoted([id_col, text_col, source_col])
    key = F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    # A source as a key that is never null, in the same order; so the window and the join below need one and the same shuffle.
    named = F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))
    own = {p + "size": F.size(words(text)).cast("long"), p + "key": key, p + "source": named}
    small = materialize(docs.select(ident, *[v.alias(k) for k, v in own.items()]), "sizes")
    rows, bits = small.count(), LEAST_BITS
    while bits < 24 and rows >> bits > RANGE_ROWS:
        bits += 1
    ranged = lambda df: df.withColumn(p + "range", F.shiftright(p + "key", 60 - bits))
    small = ranged(small)
    sized = ranged(docs.withColumns(own)) if carry else small  # texts are read again where they are carried, and never written
    targets = source_targets(small, p + "source", p + "size", **kw)
    sums = small.groupBy(F.col(p + "source").alias(p + "s"), F.col(p + "range").alias(p + "r")).agg(F.sum(p + "size").alias(p + "before"))
    upto = Window.partitionBy(p + "s").orderBy(p + "r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(p + "before", F.coalesce(F.sum(p + "before").over(upto), F.lit(0)))
    offsets = sums.join(targets, F.col(p + "s") == F.col("source")).select(
        p + "s", p + "r", p + "before", F.col("source_size").alias(p + "source_size"), F.col("target").alias(p + "target")
    )
    inside = Window.partitionBy(p + "source", p + "range").orderBy(p + "key", ident, p + "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(p + "inside", F.coalesce(F.sum(p + "size").over(inside), F.lit(0)))
    placed = placed.join(offsets, (F.col(p + "source") == F.col(p + "s")) & (F.col(p + "range") == F.col(p + "r")))
    size, all_words, budget = F.col(p + "size"), F.col(p + "source_size"), F.floor(p + "target")
    epochs = F.when(all_words > 0, F.floor(budget / F.greatest(all_words, F.lit(1)))).otherwise(0)
    rest = budget - epochs * all_words - F.col(p + "before") - F.col(p + "inside")
    taken = epochs * size + F.least(F.greatest(rest, F.lit(0)), size)
    return placed.withColumn(p + "taken", taken.cast("long")), p


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs. kw: share, most and weights of source_targets().

    taken: words that the mix takes of a row, repeats counted; of the row at the cut, some. Null text has size 0; a
    null source is a source; rows that repeat are rows of their own, and extra columns are ignored. Reruns agree, as
    the key depends on the identifier alone. No rows give no rows.
    """
    rows, p = _placed(docs, id_col, text_col, source_col, False, kw)
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(p + x).alias(x) for x in ("size", "source_size", "target", "taken")])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself, in docs' columns: a row as often as it is taken whole; the row at the cut also with the words it is taken for, joined by blanks.

    Rows without words add nothing to a mix and are not in it. n_chars, where there is one, follows the text.
    """
    rows, p = _placed(docs, id_col, text_col, source_col, True, kw)
    size, taken = F.col(p + "size"), F.col(p + "taken")
    rows = rows.filter(taken > 0).withColumn(p + "turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size))))
    n = F.least(taken - (F.col(p + "turn") - 1) * size, size).cast("int")
    text = F.col(f"`{text_col}`")
    rows = rows.withColumn(text_col, F.when(n == size, text).otherwise(F.array_join(F.slice(words(text), 1, n), " ")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast("long"))
    return rows.select(*quoted(docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(' ' || coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
a AS (
  SELECT *, first_value(CASE WHEN 2.0::DOUBLE * source_size >= level * w THEN level END IGNORE NULLS)
            OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv
  FROM l),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN 2.0::DOUBLE * source_size ELSE lv * w END AS target FROM a),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) * size
              + least(greatest(budget % greatest(source_size, 1) - before, 0), size) ELSE 0 END)::BIGINT AS taken
FROM p
"""
