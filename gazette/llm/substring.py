"""Substring deduplication by paragraph MinHash banding.

Paragraphs are a document's lines and, in a document with blank lines, the blocks between those, of any length. For
passages copied into other text or wrapped otherwise, pieces are paragraphs as well: a document's words, whatever white
space is between them, are cut where the hash of two neighbouring words is the least within REACH words on either side.
Such places depend on the words around them alone, so a passage is cut alike there, wherever it lies. Every word of a
document is in a piece; pieces have LEAST_WORDS or more where the document has.

A paragraph of SHINGLE words or more has BANDS MinHash values over its 5-word shingles; each is a band of one row, which
for a Jaccard similarity of 0.8 finds 1 - 0.2^4 = 99.84 % of pairs. Paragraphs that collide in a band are compared by
exact Jaccard similarity of their shingle sets, equal ones (shorter paragraphs too) are one paragraph from the start, and
components of similar paragraphs keep their first occurrence; the others are removals. A paragraph inside another of its
document is no occurrence of its own where both are of one component.

Keys that hold a large share of the corpus lose no pair: paragraphs that have a MinHash value of a thousandth of all band
rows or more are compared where they share one of the first shingles of each, frequent ones last (two sets of n shingles and
such a similarity share one of the first n / 5 + 1), and a set of many colliding paragraphs is compared in blocks, each
block with itself and with every other one. Joins by paragraph or component broadcast what a thousandth of the rows have.

Texts are read twice. The first pass yields distinct paragraphs and those that collide. A bitmap, in which all paragraphs
are that matter, then lets the second pass return little else: occurrences of repeated paragraphs, and the shingles of
colliding ones. The bitmap only saves work; joins by the paragraphs' 64-bit digests decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, LEAST_HOT, forget, hot_keys, materialize, shuffle_partitions
from .components import connected_components

SHINGLE, SIMILAR = 5, 0.8
REACH, LEAST_WORDS = 5, 7
BANDS = 4
#: Paragraphs of a colliding set that are compared as one block; more where the set has very many.
BLOCK = 1_024
#: log2 of a bitmap's bits: 16 for each paragraph, but 32 MB at most.
BITMAP = (20, 28)
#: Words that a run of repeated paragraphs has at least to count as a passage; shorter ones are stock phrases.
PASSAGE_WORDS = 20
#: Paragraphs whose shingles a task remembers to have returned.
SENT = 200_000
#: Documents cut together.
ROWS = 64
#: Columns of the MinHash values.
MINIMA = [f"m{k}" for k in range(BANDS)]

_U = np.uint64
#: An odd number, and its inverse modulo 2^64.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed finaliser of 64-bit hashes (that of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= _U(factor)
        x ^= x >> _U(33)
    return x


def _chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n hashes in a row."""
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """The least of every REACH numbers in a row."""
    out, n = x, 1
    while n < REACH:
        more = min(n, REACH - n)
        out = np.minimum(out[:-more], out[more:])
        n += more
    return out


def _blocks(texts: list[list[list[bytes]]]) -> np.ndarray:
    """(first, end) of runs of lines with words, counted over all texts, in those texts that have a blank line between words."""
    out, at = [], 0
    for lines in texts:
        with_words = [at + k for k, line in enumerate(lines) if line]
        gaps = [k for k in range(1, len(with_words)) if with_words[k] > with_words[k - 1] + 1]
        if gaps:
            out += [(with_words[a], with_words[b - 1] + 1) for a, b in zip([0, *gaps], [*gaps, len(with_words)], strict=True)]
        at += len(lines)
    return np.array(out, np.int64).reshape(-1, 2)


class Paragraphs:
    """The paragraphs of some texts: words [first, last) of document `doc`, digest, and shingle hashes from `shingles[at]` to `shingles[to]`."""

    def __init__(self, texts: list[bytes]):
        lines = [[line.split() for line in t.split(b"\n")] for t in texts]  # of bytes: ASCII white space
        words = [w for t in lines for line in t for w in line]
        self.n_words = np.array([sum(map(len, t)) for t in lines], np.int64)
        self.offset = np.cumsum(self.n_words) - self.n_words
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        starts = np.cumsum([0, *(len(line) for t in lines for line in t)])
        first, last = self._pieces(h, len(texts))
        blocks = _blocks(lines)
        first, last = np.concatenate((first, starts[:-1], starts[blocks[:, 0]])), np.concatenate((last, starts[1:], starts[blocks[:, 1]]))
        some = last > first
        self.first, self.last = np.divmod(np.unique(first[some] * (len(h) + 1) + last[some]), len(h) + 1)
        self.doc = np.searchsorted(self.offset, self.first, "right") - 1  # of documents of one offset, only the last has words
        self.shingles = _chain(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
        # A paragraph's digest is the sum of its words' hashes times powers of ODD, from the first word on, mixed: a difference of sums over all words.
        power, inverse = (np.multiply.accumulate(np.append(_U(1), np.full(len(h), x, np.uint64))) for x in (ODD, INVERSE))
        upto = np.append(_U(0), np.cumsum(h * power[:-1], dtype=np.uint64))
        self.digest = _mix((upto[self.last] - upto[self.first]) * inverse[self.first] + (self.last - self.first).astype(np.uint64))
        n = len(self.shingles)
        self.at, self.to = np.minimum(self.first, n), np.minimum(np.maximum(self.last - SHINGLE + 1, self.first), n)

    @cached_property
    def size(self) -> np.ndarray:
        """How many different shingles each paragraph has; 0 of those shorter than a shingle."""
        size = self.to - self.at
        order = np.argsort(self.shingles, kind="stable")
        same = self.shingles[order[1:]] == self.shingles[order[:-1]]
        # Where each shingle was before, or -1; only a paragraph that has one of its shingles before as well repeats it.
        before = np.full(len(order) + 1, -1, np.int64)
        before[order[1:][same]] = order[:-1][same]
        deep = np.flatnonzero(size)
        if len(deep):
            last = np.maximum.reduceat(before, np.column_stack((self.at[deep], self.to[deep])).ravel())[::2]
            for k in deep[last >= self.at[deep]].tolist():
                size[k] = len(np.unique(self.shingles[self.at[k] : self.to[k]]))
        return size

    def _pieces(self, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of the pieces of n_texts texts, which have all words; h: hashes of the words."""
        cut = np.zeros(len(h) + 1, bool)
        if len(h):
            most = np.iinfo(np.uint64).max
            pair = np.concatenate((h[:1], _chain(h, 2)))
            pair[self.offset[self.n_words > 0]] = most
            # Documents are kept apart by REACH places, so that none is cut by another's words.
            place = np.arange(len(h)) + REACH * (1 + np.repeat(np.arange(n_texts), self.n_words))
            spread = np.full(len(h) + REACH * (n_texts + 1), most, np.uint64)
            spread[place] = pair
            least = _least(spread)
            cut[:-1] = pair < np.minimum(least[place - REACH], least[place + 1])
            # Of two cuts less than LEAST_WORDS apart the greater goes: a short piece is merged with a neighbour.
            at = np.flatnonzero(cut)
            text = np.searchsorted(self.offset, at, "right")
            near = (np.diff(at) < LEAST_WORDS) & (text[1:] == text[:-1])
            cut[at[1:][near & (pair[at[1:]] >= pair[at[:-1]])]] = False
            cut[at[:-1][near & (pair[at[:-1]] >= pair[at[1:]])]] = False
        begin, end = self.offset, self.offset + self.n_words
        cut[begin] = cut[end] = True
        bounds = np.flatnonzero(cut)
        first, last = bounds[:-1], bounds[1:]
        # A short piece at a text's end takes words of the piece beside it, which stays as it is in other text.
        doc = np.searchsorted(begin, first, "right") - 1
        short = last - first < LEAST_WORDS
        at_begin, at_end = short & (first == begin[doc]), short & (last == end[doc])
        return np.where(at_end, np.maximum(last - LEAST_WORDS, begin[doc]), first), np.where(at_begin, np.minimum(first + LEAST_WORDS, end[doc]), last)

    def minima(self, band: int) -> np.ndarray:
        """MinHash values of one band; 0 for a paragraph without shingles."""
        out = np.zeros(len(self.at), np.uint64)
        deep = np.flatnonzero(self.size)
        if len(deep):
            # reduceat's last range has no end, so a greatest value closes the list.
            permuted = np.append(_mix(self.shingles ^ _mix(np.array([band + 1], np.uint64))), _U(np.iinfo(np.uint64).max))
            out[deep] = np.minimum.reduceat(permuted, np.column_stack((self.at[deep], self.to[deep])).ravel())[::2]
        return out


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(texts), ROWS):
        yield at, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[at : at + ROWS]]


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a.astype(np.uint64, copy=False).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in arrays]


def distinct_paragraphs(texts: DataFrame) -> DataFrame:
    """p (digest), size (different shingles), n (occurrences) and m0, m1, ... (MinHash values) of each distinct paragraph of texts (text: binary). Copies are counted before the shuffle."""
    names = ["p", "size", *MINIMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in _batches(batch.column(0)):
                got = Paragraphs(group)
                yield pa.RecordBatch.from_arrays(_longs(got.digest, got.size, *(got.minima(k) for k in range(BANDS))), names=names)

    rows = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return rows.groupBy("p").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in names[1:]])


def _by_key(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows (key, p, ...) dealt by key and sorted by key and p, through run(), which gets an iterator of (key, rows of that key as lists)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
        key, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[0] != key:
                    if held:
                        yield key, held
                    key, held = row[0], []
                held.append(row)
        if held:
            yield key, held

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "p")
    return dealt.mapInArrow(lambda batches: run(stream(batches)), schema)


def _with_shingles(distinct: DataFrame) -> DataFrame:
    return distinct.filter("size > 0").select("p", "size", *MINIMA)


def hot_minima(distinct: DataFrame) -> list[int]:
    """MinHash values that a thousandth of all of distinct's paragraphs and bands have, or more: a bounded number."""
    return [r.key for r in hot_keys(_with_shingles(distinct).select(*MINIMA)).collect()]


def band_keys(distinct: DataFrame, hot: list[int]) -> DataFrame:
    """(key, size, p) of distinct's paragraphs with shingles, a row for each band whose key is not hot."""
    rows = _with_shingles(distinct).select(F.explode(F.array(*MINIMA)).alias("key"), "size", "p")
    return rows.filter(~F.col("key").isin(hot)) if hot else rows


def hot_paragraphs(distinct: DataFrame, hot: list[int]) -> DataFrame:
    """(p): distinct's paragraphs that have a hot key in some band."""
    return _with_shingles(distinct).filter(F.lit(False) if not hot else F.greatest(*[F.col(m).isin(hot) for m in MINIMA])).select("p")


def prefix_keys(shingles: DataFrame) -> DataFrame:
    """(key, size, p) of paragraphs (p, shingles): a row for each of a paragraph's first shingles, of which any two of similarity SIMILAR share one.

    The order is that of the hashes, but shingles in a thousandth of all places or more (a bounded number) come last, so
    that they are keys only of paragraphs with little else.
    """
    frequent = [r.key for r in hot_keys(shingles.select(F.explode("shingles").alias("key"))).collect()]
    own = F.col("shingles")
    if frequent:
        those = F.array(*map(F.lit, frequent))
        ordered = F.concat(F.array_sort(F.array_except(own, those)), F.array_sort(F.array_intersect(own, those)))
    else:
        ordered = F.array_sort(own)
    first = F.slice(ordered, F.lit(1), F.expr("cast(size(shingles) div 5 as int) + 1"))
    return shingles.select(F.explode(first).alias("key"), F.size(own).cast("long").alias("size"), "p")


def _blocked(name: np.ndarray, members: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, p) of sets of paragraphs, a set's name and number of members given for each: a large set is parted into blocks, and each two blocks have a key."""
    block = np.maximum(BLOCK, 8 * np.sqrt(members).astype(np.int64))
    parts = -(-members // block)
    small = parts == 1
    keys, ps = [name[small]], [p[small]]
    large = np.flatnonzero(~small)
    if len(large):
        at = np.repeat(large, parts[large])
        other = np.arange(len(at)) - np.repeat(np.cumsum(parts[large]) - parts[large], parts[large])
        own = (p[at].view(np.uint64) % parts[at].astype(np.uint64)).astype(np.int64)
        pair = (np.minimum(own, other) << 32 | np.maximum(own, other)) + 1
        keys.append(_mix(name[at].view(np.uint64) ^ _mix(pair.view(np.uint64))).view(np.int64))
        ps.append(p[at])
    return np.concatenate(keys), np.concatenate(ps)


def colliding(keys: DataFrame) -> DataFrame:
    """(key, p): sets of two paragraphs or more of keys (key, size, p) that have a key and sizes that allow similarity; key names the set, or two blocks of a large one.

    A key's paragraphs in order of size are parted where one has less than SIMILAR of the next one's shingles: none before is
    similar to one after. Most paragraphs inside others are set apart so, before any shingles are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the key that may go on in the next batch

        def done(parts):
            parts = [x for x in parts if len(x[0])]
            if parts:
                k, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                begins = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (5 * n[:-1] < 4 * n[1:]))))
                members = np.diff(np.concatenate((begins, [len(k)])))
                name = np.add.reduceat(_mix(p.astype(np.int64).view(np.uint64)), begins).view(np.int64)
                many = np.repeat(members > 1, members)
                key, p = _blocked(np.repeat(name, members)[many], np.repeat(members, members)[many], p[many])
                for at in range(0, len(key), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 20)]), pa.array(p[at : at + (1 << 20)])], names=["key", "p"])

        for batch in batches:
            k, n, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if cut or not held or held[-1][0][-1] != k[-1]:
                yield from done([*held, (k[:cut], n[:cut], p[:cut])])
                held = []
            held.append((k[cut:], n[cut:], p[cut:]))
        yield from done(held)

    dealt = keys.repartition(shuffle_partitions(keys.sparkSession), "key").sortWithinPartitions("key", "size", "p")
    return dealt.mapInArrow(run, "key long, p long").distinct()


def bitmap(ids: DataFrame) -> Broadcast:
    """A broadcast bitmap, in which the bits of all ids (p: long) are set: 16 bits for each of them, as a power of two, and 32 MB at most."""
    log2 = min(BITMAP[1], max(BITMAP[0], (16 * ids.count()).bit_length()))
    place = ids.select(F.expr(f"p & {(1 << log2) - 1}").alias("place"))
    words = place.select(F.expr("cast(place >> 5 as int)").alias("w"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(1 << (log2 - 5), np.uint32)
    for part in found.toArrow().to_batches():
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(bits)


def _in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = (ids & _U(32 * len(bits) - 1)).astype(np.int64)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points of its text, end exclusive) of each word of some UTF-8 texts, in order."""
    text = np.frombuffer(b"\n".join(texts), np.uint8)
    word = np.concatenate(([False], (text != 32) & ((text < 9) | (text > 13)), [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    of = points[begins[np.searchsorted(begins, starts, "right") - 1]]
    return points[starts] - of, points[ends] - of


def occurrences(texts: DataFrame, repeated: Broadcast, compared: Broadcast) -> DataFrame:
    """p, doc_id, start, end (code points, end exclusive), word (of the document, where it starts), n_words and shingles of the paragraphs in `repeated`; shingles only of those in `compared`, and once or more, else null."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # paragraphs whose shingles have been returned by this task
        for batch in batches:
            for row, group in _batches(batch.column(1)):
                got = Paragraphs(group)
                starts, ends = places(group)
                hits = np.flatnonzero(_in(repeated.value, got.digest))
                shingles: list[np.ndarray | None] = [None] * len(hits)
                for at in np.flatnonzero(_in(compared.value, got.digest[hits])).tolist():
                    k = hits[at]
                    if (p := int(got.digest[k])) not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(p)
                        shingles[at] = np.unique(got.shingles[got.at[k] : got.to[k]]).view(np.int64)
                docs = batch.column(0).take(pa.array(row + got.doc[hits]))
                first, last = got.first[hits], got.last[hits]
                longs = _longs(starts[first], ends[last - 1], first - got.offset[got.doc[hits]], last - first)
                columns = [*_longs(got.digest[hits]), docs, *longs, pa.array(shingles, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "doc_id", "start", "end", "word", "n_words", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, f"p long, doc_id {kind}, start long, end long, word long, n_words long, shingles array<long>")


def similar(sets: list[tuple[int, frozenset]]) -> list[tuple[int, int]]:
    """Links between sets of a Jaccard similarity of SIMILAR or more that join all that such pairs join.

    Only pairs that share one of their least few elements are compared: two sets of such a similarity share one of the
    first n - ceil(SIMILAR * n) + 1 of each, in any common order. Pairs already joined are passed over.
    """
    boss = list(range(len(sets)))

    def find(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    links, index = [], defaultdict(list)
    counts: dict[int, int] = defaultdict(int)
    for _, s in sets:
        for e in s:
            counts[e] += 1
    for k, (p, s) in enumerate(sets):
        n = len(s)
        least = sorted(s, key=lambda e: (counts[e], e))[: n - -(-4 * n // 5) + 1]
        for j in {j for e in least for j in index[e]}:
            if find(j) != find(k):
                q, t = sets[j]
                if min(n, len(t)) >= SIMILAR * max(n, len(t)):
                    both = len(s & t)
                    if 5 * both >= 4 * (n + len(t) - both):
                        links.append((p, q))
                        boss[find(j)] = find(k)
        for e in least:
            index[e].append(k)
    return links


def verified(candidates: DataFrame, shingles: DataFrame) -> DataFrame:
    """(u, v): links between paragraphs of candidates (key, p) that meet in a key and are similar by shingles (p, shingles; a row for each p)."""

    def run(groups: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for _, rows in groups:
            links += similar([(p, frozenset(s)) for _, p, s in rows])
            if len(links) > 50_000:
                yield out()
                links = []
        yield out()

    return _by_key(candidates.join(shingles, "p").select("key", "p", "shingles"), run, "u long, v long").distinct()


def _dealt(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to side, a row for each key; n: how many of rows have it. Keys of a share of HOT or more, a bounded number, are broadcast, so their rows stay where they are."""
    least = max(LEAST_HOT, HOT * (side.agg(F.sum(n)).first()[0] or 0))
    hot = F.broadcast(side.filter(F.col(n) >= least))
    cold = rows.join(F.broadcast(side.filter(F.col(n) >= least).select(key)), key, "left_anti").join(side.filter(F.col(n) < least), key)
    return rows.join(hot, key).unionByName(cold)


def _own() -> Column:
    """Rows without an identifier are not told apart by document, so each is dealt by itself."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("p", "start", "end"))


def _outermost(rows: DataFrame) -> DataFrame:
    """rows without those inside another of the same document and component. Documents without an identifier are not told apart, so theirs stay."""
    place = Window.partitionBy("component", "doc_id", _own()).orderBy("start")
    before = F.max("end").over(place.rangeBetween(Window.unboundedPreceding, -1))
    here = F.max("end").over(place.rangeBetween(0, 0))
    inside = F.coalesce(before >= F.col("end"), F.lit(False)) | (here > F.col("end"))
    return rows.withColumn("inside", inside & F.col("doc_id").isNotNull()).filter("not inside").drop("inside")


def _runs(rows: DataFrame) -> DataFrame:
    """rows with run_words, the words of the run of adjoining or overlapping rows of the document that each is in; n_words where there is no identifier."""
    of_doc = Window.partitionBy("doc_id", _own())
    before = F.max("last").over(of_doc.orderBy("word", "last").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last", F.col("word") + F.col("n_words"))
    rows = rows.withColumn("opens", F.when(F.coalesce(before >= F.col("word"), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("opens").over(of_doc.orderBy("word", "last").rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("doc_id", _own(), "run")
    words = F.when(F.col("doc_id").isNull(), F.col("n_words")).otherwise(F.max("last").over(of_run) - F.min("word").over(of_run))
    return rows.withColumn("run_words", words).drop("last", "opens", "run")


def paragraph_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = 1, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """The paragraphs that occur again, in like or equal words: doc_id, start, end, n_words, run_words, passage, keep_doc_id, keep_start, copies, removed.

    A row for each occurrence (lines, blocks and pieces may overlap); occurrences of one component have one keep_doc_id and
    keep_start, those of the first of them (by identifier, null last, then place), which stays; the others are removed. copies
    counts the component's. run_words counts the words of the stretch of repeated text that the row is part of; passage tells
    stretches of passage_words or more from stock phrases, so that a caller can leave documents alone which share no more than
    those. With least_run, only stretches of so many words or more are returned.
    Documents without a repeated paragraph have no row. Null and empty texts have no paragraphs; paragraphs shorter than a
    shingle are repeated only by equal ones. Rows that repeat whole are occurrences of their own, but share their place.
    Extra columns are ignored; no rows give no rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    distinct = materialize(distinct_paragraphs(texts.select("text")), "paragraphs")
    hot = hot_minima(distinct)
    candidates = materialize(colliding(band_keys(distinct, hot)), "colliding")
    meeting = candidates.select("p").distinct()
    if hot:
        meeting = meeting.unionByName(hot_paragraphs(distinct, hot)).distinct()
    repeated = distinct.filter("n > 1").select("p", "n")
    found = materialize(occurrences(texts, bitmap(repeated.select("p").unionByName(meeting)), bitmap(meeting)), "occurrences")
    shingles = found.filter("shingles is not null").groupBy("p").agg(F.first("shingles").alias("shingles"))
    links = verified(candidates, shingles)
    if hot:
        of_hot = materialize(shingles.join(hot_paragraphs(distinct, hot), "p", "left_semi"), "hot-shingles")
        links = links.unionByName(verified(materialize(colliding(prefix_keys(of_hot)), "colliding-hot"), of_hot))
    components = connected_components(links).select(F.col("node").alias("p"), "component")
    alone = repeated.join(components, "p", "left_anti").select("p", F.col("p").alias("component"), "n")
    named = components.join(repeated, "p", "left").select("p", "component", F.coalesce("n", F.lit(1)).alias("n")).unionByName(alone)
    rows = _outermost(_dealt(found.drop("shingles"), materialize(named, "named"), "p", "n").drop("n"))
    rows = materialize(rows, "placed")
    for used in (distinct, candidates, found):
        forget(used)
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "start")
    keep = rows.groupBy("component").agg(F.min(first).alias("keep"), F.count("*").alias("copies")).filter("copies > 1")
    rows = _runs(_dealt(rows, materialize(keep, "keep"), "component", "copies")).filter(F.col("run_words") >= least_run)
    here = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start"))
    passage = F.col("run_words") >= passage_words
    kept = [F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start")]
    return rows.select("doc_id", "start", "end", "n_words", "run_words", passage.alias("passage"), *kept, "copies", (~here).alias("removed"))
