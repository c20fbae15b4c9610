"""SimHash near-deduplication by anchor-point covering.

Fingerprints of 64 bits are linked when 3 or fewer bits differ. Then one of their two halves differs in at most 1 bit,
so each half is covered by itself: 31 of its 32 bits by the perfect Hamming code, whose words lie within 1 bit of
every point, and the last bit as it is. A half's anchors are the code words (with a last bit) within the covering
radius plus the threshold, 1 + 1 = 2 bits: the nearest anchor of one fingerprint is among those of every fingerprint
linked to it through this half. A fingerprint has 2 or 17 of 2^27 anchors for a half, and fingerprints are compared in
full within each anchor. Equal fingerprints are one point, so copies meet no anchor twice.

An anchor that holds a thousandth of all points or more is parted, and so is one of more than LARGE points within its
task: of two points that meet by one half, the other half's two quarters differ in at most 3 bits, so one of them differs
in at most 1, and the quarters are covered by the same rule with the [15,11] code. A parted anchor's points have 4 to 18
of 2 x 2^12 parts each.

An anchor's fingerprints come sorted, 8 bytes each. Pairs are not listed: an anchor's points are taken off a list as
they are reached from one another, and a link is returned for each point reached, which leaves the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, materialize, prefix, quoted, shuffle_partitions
from .components import connected_components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Shingles whose bits are unpacked at a time.
BLOCK = 16_384


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text: words of 3 in a row, A-Z in lower case; 0 for a text of no words."""
    words = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -SHINGLE]))
    stops = ends[SHINGLE - 1 :] - 1
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a long column `name`, the bits of fingerprint() of each whole text. Null text is a text of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, texts = batch.columns
            got = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(got, pa.int64())], names=out.names)

    out = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.withColumn(name, F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, out)


@lru_cache
def _columns(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome s of the Hamming code of n - 1 bits, the masks that lead to code words within 2 bits, and how many there are."""
    masks, counts = np.zeros((n, n // 2), np.uint64), np.zeros(n, np.int64)
    bit = lambda i: 1 << (i - 1)  # noqa: E731  column i of the code's check matrix is i in binary
    for s in range(n):
        found = [0] if s == 0 else [bit(s), *[bit(i) | bit(i ^ s) for i in range(1, n) if i < i ^ s]]
        masks[s, : len(found)], counts[s] = found, len(found)
    return masks, counts


def syndromes(points: np.ndarray, n: int = 32) -> np.ndarray:
    """The exclusive or of the numbers of the bits set, of bits 1 to n - 1."""
    s = np.zeros(len(points), np.int64)
    for i in range(1, n):
        s ^= ((points >> np.uint64(i - 1)) & np.uint64(1)).astype(np.int64) * i
    return s


def covered(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in v, anchor) of every anchor of each point of n bits, n a power of two: points that differ in 1 bit or none share one."""
    masks, counts = _columns(n)
    at, to = [], []
    s = syndromes(v & np.uint64((1 << (n - 1)) - 1), n)
    for k in range(masks.shape[1]):
        has = np.flatnonzero(counts[s] > k)
        at.append(has)
        to.append(v[has] ^ masks[s[has], k])
    # The last bit differs: 1 bit is left for the code.
    at.append(np.arange(len(v)))
    to.append(v ^ masks[s, 0] ^ np.uint64(1 << (n - 1)))
    return np.concatenate(at), np.concatenate(to)


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in points, anchor) of every anchor of each fingerprint: bit 32 tells the half, bits 0 to 31 are the anchor's."""
    both = [covered((points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 32) for half in (0, 1)]
    return np.concatenate([at for at, _ in both]), np.concatenate([to | np.uint64(half << 32) for half, (_, to) in enumerate(both)])


#: Set in the name of an anchor's part, and in no anchor.
PART = np.uint64(1 << 62)


def parts(anchor: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, part) of every part of its anchor that each point is in: by the quarters of the half that the anchor is not of."""
    other = (points >> np.where(anchor >> np.uint64(32) == 0, np.uint64(32), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    at, to = [], []
    for quarter in (0, 1):
        k, found = covered((other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF), 16)
        # An anchor of 33 bits, a quarter and its anchor of 16: 50 bits.
        at.append(k)
        to.append(PART | anchor[k] << np.uint64(17) | np.uint64(quarter << 16) | found)
    return np.concatenate(at), np.concatenate(to)


def linked(points: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is joined in `points` (distinct) by 3 or fewer differing bits: each point when first reached."""
    links, left = [], points.copy()
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            x, reached = reached[-1], reached[:-1]
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                reached, left = np.concatenate((reached, left[near])), left[~near]
    return links


#: Anchors of up to so many points are compared all at once, by the distance between the places of two points; those of more than LARGE are parted.
SMALL, LARGE = 32, 4_096


def _links_of_sorted(anchor: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each anchor, of rows sorted by anchor in which every anchor is complete."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    u, v = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    a, p = anchor[small], point[small]
    for k in range(1, min(SMALL, len(a))):
        same = np.flatnonzero(a[k:] == a[:-k])
        if not len(same):
            break
        same = same[np.bitwise_count(p[same] ^ p[same + k]) <= THRESHOLD]
        u.append(p[same])
        v.append(p[same + k])
    for at in np.flatnonzero(sizes > SMALL):
        of = slice(starts[at], starts[at] + sizes[at])
        if sizes[at] > LARGE and not anchor[starts[at]] & PART:
            place, part = parts(anchor[of], point[of])
            order = np.lexsort((point[of][place], part))
            for found, more in zip((u, v), _links_of_sorted(part[order], point[of][place[order]]), strict=True):
                found.append(more)
            continue
        links = linked(point[of])
        u.append(np.array([x for x, _ in links], np.uint64))
        v.append(np.array([y for _, y in links], np.uint64))
    return (np.concatenate(u), np.concatenate(v)) if u else (point[:0], point[:0])


def fingerprint_links(points: DataFrame) -> DataFrame:
    """(u, v): links of the distinct longs in `points`' one column that join all that is joined by 3 or fewer differing bits."""

    hot = np.zeros(0, np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, to = anchors(p)
            much = np.isin(to, hot)
            if much.any():
                k, part = parts(to[much], p[at[much]])
                at, to = np.concatenate((at[~much], at[much][k])), np.concatenate((to[~much], part))
            yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(p[at].view(np.int64))], names=["anchor", "point"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the anchor that may go on in the next batch
        last = None

        def done(parts):
            if parts:
                u, v = _links_of_sorted(*[np.concatenate(x).view(np.uint64) for x in zip(*parts, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            a, p = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(a):
                continue
            cut = int(np.searchsorted(a, a[-1]))
            if last is not None and a[-1] == last and cut == 0:
                held.append((a, p))
                continue
            yield from done([*held, (a[:cut], p[:cut])])
            held, last = [(a[cut:], p[cut:])], a[-1]
        yield from done(held)

    points = points.select(F.col(points.columns[0]).alias("point"))
    # A bounded number of keys; deal() has them from here on.
    hot = np.array([r.key for r in hot_keys(points.mapInArrow(deal, "anchor long, point long").select(F.col("anchor").alias("key"))).collect()], np.int64).view(np.uint64)
    spread = points.mapInArrow(deal, "anchor long, point long")
    dealt = spread.repartition(shuffle_partitions(points.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each row of docs.

    component_id is the smallest identifier that links reach, a row's own included. Texts of no words, null ones too,
    have fingerprint zero and are linked like any other. Rows that repeat are rows of one fingerprint. Extra columns are
    ignored. A null identifier is never a component's, unless its component has no other. No rows give no rows.
    """
    p = prefix(docs)
    fps = with_fingerprints(docs.select(*quoted([id_col, text_col])), text_col, p + "fp").select(F.col(f"`{id_col}`").alias("doc_id"), p + "fp")
    fps = materialize(fps, "simhash")
    rows = _grouped(fps, p + "fp")
    return rows.select("doc_id", F.lower(F.lpad(F.hex(p + "fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _grouped(fps: DataFrame, fp: str) -> DataFrame:
    """fps (doc_id, fp) with least, the smallest doc_id of the component."""
    points = materialize(fps.groupBy(fp).agg(F.min("doc_id").alias("first")), "simhash-points")
    found = connected_components(fingerprint_links(points.select(fp)))
    labelled = points.join(found, points[fp] == found["node"], "left").select(fp, "first", F.coalesce("component", fp).alias("component"))
    ids = labelled.groupBy("component").agg(F.min("first").alias("least"))
    named = labelled.join(ids, "component").select(F.col(fp).alias("point"), "least")
    return fps.join(named, fps[fp] == named["point"])


def simhash_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which simhash_groups() names the identifier as its component's, in docs' columns; a row with a null identifier stays.

    Rows that go are told by identifier and a hash of the text, so texts are read twice and never written.
    """
    p = prefix(docs)
    ident = F.col(f"`{id_col}`")
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    fps = with_fingerprints(docs.select(ident, F.col(f"`{text_col}`"), mark.alias(p + "mark")), text_col, p + "fp")
    fps = materialize(fps.select(ident.alias("doc_id"), p + "mark", p + "fp"), "simhash")
    gone = _grouped(fps, p + "fp").filter("doc_id <> least").select(F.col("doc_id").alias(p + "gone"), F.col(p + "mark").alias(p + "of")).distinct()
    gone = materialize(gone, "simhash-gone")  # so that its size is known, and the texts are shuffled only where it is large
    return docs.join(gone, (ident == F.col(p + "gone")) & (mark == F.col(p + "of")), "left_anti")
