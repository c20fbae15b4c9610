"""Set similarity self-joins without comparing all pairs.

Two sets of Jaccard similarity t or more share one of the first n - ceil(t * n) + 1 elements of each, in any common
order. With the rarest elements first, few sets share such an element, so an equi-join on it leaves few candidates, and
those are compared in full. Exact: nothing is missed, and no side is broadcast unless Spark finds it small.

Equal sets are one class, of which one set is compared; pairs of rows come from pairs of classes at the end. Elements and
classes are told apart by 64-bit digests. No element is shuffled by itself: how rare it is comes from a broadcast table of
counts by digest, in which elements may share a place, since any order will do that all sets have in common. Candidates
are left out whose signatures (the parity of the elements by digest) differ in more places than similar sets have elements
of their own; the others meet by their least digest, which similar sets mostly share, so that a set with many
like it is sent to few places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: Places of the table of counts; a power of two, a byte each.
PLACES = 1 << 22
#: Candidates that meet by one pair of least digests and are compared in one task; more are parted.
TOGETHER = 50_000

_U = np.uint64


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements (unsigned) of a column of arrays of longs without nulls, and where each row's begin, with the end."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def rarity(sets: DataFrame) -> Broadcast:
    """A broadcast array: at an element's place (digest modulo PLACES), 8 times the binary logarithm of how many elements of sets (e) are there, rounded; 0 for one or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, np.int64)
        for batch in batches:
            found, times = np.unique(_lists(batch.column(0))[0] & _U(PLACES - 1), return_counts=True)
            n[found.astype(np.int64)] += times
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["place", "n"])

    counts = sets.select("e").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).filter("n > 1")
    out = np.zeros(PLACES, np.uint8)
    for part in counts.select("place", F.least(F.lit(255), F.round(8 * F.log2("n"))).cast("short").alias("r")).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return sets.sparkSession.sparkContext.broadcast(out)


def prefixes(sets: DataFrame, threshold: float, rare: Broadcast) -> DataFrame:
    """(token, c, n, at): of each set (c, e), the places (from 1) of the rarest of its n elements, without those that are in no other set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begins = _lists(batch.column(1))
            ordered = rare.value[(flat & _U(PLACES - 1)).astype(np.int64)].astype(np.uint64) << _U(56) | flat >> _U(8)
            tokens, lengths = [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                # A little less than the threshold, so that rounding never shortens a prefix.
                tokens.append(np.sort(ordered[a:b])[: b - a - math.ceil((threshold - 1e-9) * (b - a)) + 1])
                lengths.append(len(tokens[-1]))
            if not tokens:
                continue
            token, lengths = np.concatenate(tokens), np.array(lengths)
            at = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            met = token >> _U(56) > 0
            c, n = (np.repeat(x, lengths)[met] for x in (batch.column(0).to_numpy(), np.diff(begins)))
            yield pa.RecordBatch.from_arrays([pa.array(token[met].view(np.int64)), pa.array(c), pa.array(n.astype(np.int32)), pa.array(at[met].astype(np.int32))], names=["token", "c", "n", "at"])

    return sets.select("c", "e").mapInArrow(run, "token long, c long, n int, at int").groupBy("token", "c").agg(F.min("n").alias("n"), F.min("at").alias("at"))


def signatures(sets: DataFrame) -> DataFrame:
    """(c, n, least, bits): of each set (c, e), its size, its least element, and the parity of its elements by digest modulo a power of two of n or more, 64 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begins = _lists(batch.column(1))
            bits = []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                most = max(64, 1 << (b - a - 1).bit_length())
                odd = np.bincount((flat[a:b] >> _U(22) & _U(most - 1)).astype(np.int64), minlength=most) & 1
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            n, least = np.diff(begins).astype(np.int32), flat[begins[:-1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(least), pa.array(bits, pa.list_(pa.int64()))], names=["c", "n", "least", "bits"])

    names = ["n", "least", "bits"]
    return sets.select("c", "e").mapInArrow(run, "c long, n int, least long, bits array<long>").groupBy("c").agg(*[F.first(x).alias(x) for x in names])


def _folded(bits: Column, size: Column) -> Column:
    """bits by digest modulo half as many places, where there are more than size."""
    half = F.size(bits).cast("double") / 2
    halves = [F.slice(bits, at, half.cast("int")) for at in (F.lit(1), half.cast("int") + 1)]
    return F.when(F.size(bits) > size, F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def candidates(sets: DataFrame, threshold: float, rare: Broadcast) -> DataFrame:
    """(a, b, la, lb): pairs of different sets (c, e) that may be similar, a the smaller one, and their least elements."""
    t = threshold - 1e-9
    short = written(prefixes(sets, threshold, rare), "prefixes")
    # The smaller of two sets shares one of a still shorter prefix: their sizes' sum is twice its size or more.
    left = short.filter(F.col("at") <= F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n")) + 1).select("token", F.col("c").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"))
    right = short.select("token", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("at").alias("atb"))
    both = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # Of the first element that they share, what follows in either is all that they can share besides.
    fits = (F.col("na") >= t * F.col("nb")) & (1 + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= both)
    met = left.join(right, "token").filter(order & fits).select("a", "b").distinct()
    signed = written(signatures(sets), "signatures")
    of = lambda x: signed.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("least").alias(f"l{x}"), F.col("bits").alias(f"s{x}"))
    met = met.join(of("a"), "a").join(of("b"), "b")
    # Sizes that differ by less than a half have signatures of one size, or of twice that.
    for _ in range(1 + math.ceil(-math.log2(t))):
        met = met.withColumn("sb", _folded(F.col("sb"), F.size("sa")))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    found = written(met.filter(apart <= F.col("na") + F.col("nb") - 2 * both).select("a", "b", "la", "lb"), "candidates")
    forget(short)
    forget(signed)
    return found


def _of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of sets (c, e) in wanted (c), and few others where those are not very many; a broadcast table of PLACES marks tells."""
    marks = np.zeros(PLACES, bool)
    for part in wanted.select(F.expr(f"cast(c & {PLACES - 1} as int)").alias("place")).distinct().toArrow().to_batches():
        marks[part.column(0).to_numpy()] = True
    sent = sets.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value[batch.column(0).to_numpy() & (PLACES - 1)]))

    return sets.select("c", "e").mapInArrow(run, "c long, e array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): those of pairs (a, b, la, lb) whose sets (c, e) have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for k, (g, a, b) in enumerate(zip(*columns, strict=True)):
                if g != group:
                    group, held = g, {}
                if b is None:
                    held[a] = frozenset(batch.column(3)[k].values.to_numpy().tolist())
                else:
                    s, u = held[a], held[b]
                    both = len(s & u)
                    if (score := both / (len(s) + len(u) - both)) >= threshold:
                        found.append((a, b, score))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "score"])

    many = pairs.groupBy("la", "lb").agg(F.count("*").alias("pairs")).filter(F.col("pairs") > TOGETHER)
    parts = F.coalesce(F.ceil(F.sqrt(F.col("pairs") / TOGETHER)), F.lit(1))
    group = F.xxhash64("la", "lb", F.pmod("a", parts), F.pmod("b", parts))
    dealt = pairs.join(many, ["la", "lb"], "left").select(group.alias("g"), "a", "b")
    needed = written(dealt.select("g", F.explode(F.array("a", "b")).alias("c")).distinct(), "needed")
    own = _of(sets, needed).groupBy("c").agg(F.first("e").alias("e"))
    sent = needed.join(own, "c").select("g", F.col("c").alias("a"), F.lit(None).cast("long").alias("b"), "e")
    rows = sent.unionByName(dealt.withColumn("e", F.lit(None).cast("array<long>")))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long, score double")


def similar_pairs(sets: DataFrame, key: str, elements: str, threshold: float, earlier: Column | None = None) -> DataFrame:
    """(a, b, score) for pairs of `sets` (key; elements, an array without repeats) with a < b and Jaccard similarity of `threshold` or more.

    earlier: a condition on columns a and b instead of a < b, where order is not that of the key. Empty sets are in no pair.
    """
    digests = F.sort_array(F.transform(elements, lambda x: F.xxhash64(x)))
    rows = sets.filter(F.size(elements) > 0).select(F.col(key).alias("key"), digests.alias("e")).withColumn("c", F.xxhash64("e"))
    rows = written(rows, "sets")
    pairs = candidates(rows, threshold, rarity(rows))
    links = written(verified(pairs, rows, threshold), "links")
    forget(pairs)
    members = written(rows.select("key", "c"), "members")
    forget(rows)
    equal = members.groupBy("c").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("c").alias("u"), F.col("c").alias("v"), F.lit(1.0).alias("score"))
    of = lambda name, side: members.select(F.col("c").alias(name), F.col("key").alias(side))
    met = links.toDF("u", "v", "score").unionByName(equal).join(of("u", "a"), "u").join(of("v", "b"), "v")
    # Classes of a link are in either order; those of equal rows meet in both.
    one, other = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    ways = F.when(F.col("u") == F.col("v"), F.array(one)).otherwise(F.array(one, other))
    return met.select(F.explode(ways).alias("way"), "score").select("way.a", "way.b", "score").filter((F.col("a") < F.col("b")) if earlier is None else earlier)
