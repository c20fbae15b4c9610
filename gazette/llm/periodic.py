"""Periodic runs of words: maximal stretches that repeat with a smallest period.

The root of every run is, under some order of the words or its reverse, the longest Lyndon word that starts where it
starts. So a text is scanned from right to left twice, once under each order: the factors to the right stand on a stack,
and the word that starts here takes in factors from the top while it is less than they are. Comparisons that go on
after the first words are longest common extensions (LCE): prefix sums of a rolling hash modulo 2^64, the length searched
by doubling and halving, then the words themselves compared. Unequal hashes prove words unequal, and equal ones are
never relied on. No suffix array is built.

Only runs of EXPONENT periods or more are wanted. All three-word sequences inside such a run occur three times
in it or more, so words outside of stretches whose three-word sequences recur within the stretch are in no run; these are
cut away first, stretch by stretch until none changes, and the stack scans only what remains, which in ordinary prose is
little. The extension of a run is searched in the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix, quoted, text_groups, words

LEAST_WORDS, EXPONENT = 6, 4
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are taken from a batch at a time.
SLICE = 4 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


class Texts:
    """A sequence of word numbers with longest common extensions, forwards and backwards."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.n, BASE, np.uint64))), dtype=np.uint64)
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * self.power[:-1], dtype=np.uint64)))

    def hashed(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of `length` words at i and at j (i <= j) are equal; if not, the words differ."""
        s = self.sums
        a, b = int(s[i + length]) - int(s[i]), int(s[j + length]) - int(s[j])
        return (a * int(self.power[j - i]) - b) & MASK == 0

    def _search(self, equal, most: int) -> int:
        """The greatest length up to `most` for which equal(length) holds, which holds for 0 and for all lengths below one for which it does."""
        low, step = 0, 8
        while low < most and equal(min(most, low + step)):
            low, step = min(most, low + step), step * 2
        high = min(most + 1, low + step)  # not equal, or beyond
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if equal(mid) else (low, mid)
        return low

    def forwards(self, i: int, j: int, most: int) -> int:
        """How many words from i on equal those from j on, up to `most`; i < j."""
        length = self._search(lambda k: self.hashed(i, j, k), most)
        differ = np.flatnonzero(self.ids[i : i + length] != self.ids[j : j + length])
        return int(differ[0]) if len(differ) else length

    def backwards(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        length = self._search(lambda k: self.hashed(i - k, j - k, k), i)
        differ = np.flatnonzero(self.ids[i - length : i] != self.ids[j - length : j])
        return length - 1 - int(differ[-1]) if len(differ) else length


def lyndon_ends(text: Texts, start: int, ranks: list[int]) -> list[int]:
    """For each word of the stretch at `start`, where the longest Lyndon word that starts there ends (both within the stretch); ranks give the order.

    ends[j] is the factor on top of the stack at j, and the factor below it starts at ends[j]: the stack is in the list.
    """
    n = len(ranks)
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        j, first = i + 1, ranks[i]
        while j < n:
            other = ranks[j]
            if first > other:
                break
            if first == other:
                most = min(j - i, ends[j] - j)
                k = 1
                while k < most and k < 8 and ranks[i + k] == ranks[j + k]:
                    k += 1
                if k == 8 < most and ranks[i + 8] == ranks[j + 8]:
                    k = text.forwards(start + i, start + j, most)
                if (ranks[i + k] > ranks[j + k]) if k < most else j - i >= ends[j] - j:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the stretches that may hold runs of EXPONENT periods and LEAST_WORDS words."""
    if len(ids) < LEAST_WORDS:
        return []
    with np.errstate(over="ignore"):
        # A sequence's number may be another's too; then too much is kept, never too little.
        x = ids.astype(np.uint64) + np.uint64(1)
        grams = (x[:-2] * np.uint64(BASE) ^ (x[1:-1] << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9) + x[2:] * np.uint64(0x94D049BB133111EB)
    at = np.arange(len(grams))
    while len(at):
        begins = np.diff(at, prepend=-2) != 1
        part = np.cumsum(begins)
        size = np.bincount(part)[part]
        with np.errstate(over="ignore"):
            key = (grams[at] ^ part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(BASE)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        good = (count[which] >= 3) & (size >= LEAST_WORDS - 2)
        if good.all():
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(at)) - 1
            return [(int(at[a]), int(at[b]) + 3) for a, b in zip(first, last, strict=True)]
        at = at[good]
    return []


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of `least` words and `exponent` (EXPONENT or more) periods, by start, then by period."""
    parts = stretches(ids)
    if not parts:
        return []
    text = Texts(ids)
    found: set[tuple[int, int, int]] = set()
    for start, end in parts:
        ranks = ids[start:end].tolist()
        done: dict[int, int] = {}  # period: where the last run of that period that has been extended ends
        candidates = set()
        for order in (ranks, [-r for r in ranks]):
            i = np.arange(start, end)
            p = np.array(lyndon_ends(text, start, order), np.int64) + start - i
            # The first root of a run of four periods is followed by two more, so 2p words from here on equal those p further.
            fits = i + 3 * p <= end
            i, p = i[fits], p[fits]
            with np.errstate(over="ignore"):
                same = (text.sums[i + 2 * p] - text.sums[i]) * text.power[p] == text.sums[i + 3 * p] - text.sums[i + p]
            candidates.update(zip(i[same].tolist(), p[same].tolist(), strict=True))
        for i, p in sorted(candidates):
            if i + 2 * p <= done.get(p, 0):
                continue  # within a run that is known
            right = text.forwards(i, i + p, text.n - i - p)
            left = text.backwards(i, i + p)
            if left + right >= p:
                done[p] = i + p + right
                if left + p + right >= max(least, exponent * p):
                    found.add((i - left, left + p + right, p))
    return sorted(found)


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n words, whether a run holds it after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def collapse(text: bytes, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(words, runs, text of the words that are kept, joined by spaces) of a UTF-8 text."""
    found = text.split()  # of bytes: at ASCII white space only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    runs = runs_of(ids, least, exponent)
    if runs:
        found = [w for w, gone in zip(found, dropped_words(len(found), runs).tolist(), strict=True) if not gone]
    return len(ids), runs, b" ".join(found)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """id_col, n_words, runs (array of start, length, period; by start, then by period) and collapsed (the words that no run repeats, joined by spaces) for each row of docs.

    A run is a stretch of words with a smallest period, of `least` words and `exponent` periods or more (not below EXPONENT), that cannot be
    extended. Words are what stands between ASCII white space. A null text has no words, nor has one of white space
    alone: 0, no runs, an empty text. Rows that repeat, and null identifiers, give rows of their own; no rows give none.
    Extra columns are ignored. A text is taken whole, however long, within one task; batches are cut by bytes of text.
    """
    if exponent < EXPONENT:
        raise ValueError(f"runs of fewer than {EXPONENT} periods are not searched")
    p = prefix(docs)
    rows = docs.select(quoted([id_col])[0].alias(p + "id"), F.coalesce(quoted([text_col])[0].cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_groups(batch.column(1), SLICE):
                ids, texts = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                counts, runs, left = zip(*(collapse(x.as_buffer().to_pybytes(), least, exponent) for x in texts), strict=True)
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, structs, type=kind), pa.array(left, pa.binary()).cast(pa.string())], names=names)

    names = [id_col, "n_words", "runs", "collapsed"]
    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, runs {RUNS}, collapsed string")


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col, the text of one row in ten (by the CRC-32 of its decimal identifier) periodic from some word on.

    With h the CRC-32 and g = h / 10: where 10 divides h, of n words those from a = g mod n on become the p = 1 + (n - a) / (3 + g mod 8)
    words at a, over and over. Texts without words, and rows without an identifier, stay as they are.
    """
    identifier, text = quoted([id_col, text_col])
    text = text.cast("string")
    h = F.crc32(identifier.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tailed(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    return docs.select(identifier, F.when((h % 10 == 0) & text.isNotNull(), let(words(text), tailed)).otherwise(text).alias(text_col))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of the greatest exponent, runs_sha256 and collapsed_sha256 of each row of docs with planted tails."""
    rows = periodic_runs(with_planted_tails(docs))
    none = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("period"))
    # In their order, so the first of equal exponents has the smallest start, then the smallest period.
    best = F.aggregate("runs", none, lambda top, r: F.when(top["start"].isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    each = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    exact = F.expr("best.length * 1000 div best.period")
    return each.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def _crc(text: str) -> str:
    """CRC-32 of a text of ASCII characters: each brings its code, then seven zeros, and every step shifts by one bit."""
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    codes = f"list_transform(range(8 * len({text})), lambda k: CASE WHEN k % 8 = 0 THEN ord(substr({text}, k // 8 + 1, 1))::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: {step}), 4294967295::BIGINT)"


#: Stretches of equal words q apart are islands of an equality join; a stretch's smallest period is the least that gives it.
ORACLE_SQL = f"""
WITH split AS (
    SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, {_crc("doc_id::VARCHAR")} AS h
    FROM documents
),
sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
tails AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
texts AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM tails),
tokens AS (SELECT k, n, unnest(w) AS t, unnest(range(n)) AS i FROM texts),
equal AS (SELECT x.k, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.k = y.k AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS part FROM equal),
longest AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY k, q, part HAVING count(*) + q >= greatest({LEAST_WORDS}, {EXPONENT} * q)),
runs AS (SELECT k, s, l, min(q) AS q FROM longest GROUP BY k, s, l),
best AS (SELECT k, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY l::DOUBLE / q DESC, s, q) = 1),
lines AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT k, string_agg(t, ' ' ORDER BY i) AS x FROM tokens ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, l * 1000 // q AS exponent_milli,
    sha256(coalesce(lines.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256, n AS n_words
FROM texts LEFT JOIN best USING (k) LEFT JOIN lines USING (k) LEFT JOIN kept USING (k)
"""
