"""Byte-level BPE encoding and decoding with a word lexicon.

The words of all documents are counted, and the most frequent, with the ids that BPE gives them, are compiled into a
minimal acyclic transducer: an automaton whose words share prefixes and suffixes, and whose edges carry how many words
they pass over, so that a path's sum is its word's number and leads to its ids. The compiled file goes to each
executor once; its workers map it into memory, read ids from the map, look words up many at a time, and merge exactly
those that are not in it. Texts are encoded, and decoded again, a few megabytes at a time in one worker, and a text of
any length in blocks of its words, so that memory does not grow with how many or how long the texts are.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, new_path, prefix, text_groups, write_bytes

#: How byte-level BPE splits a text before merging (fixed by the vocabulary). No two alternatives but the last four begin alike, so letters, the commonest, come first.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the regex module knows as letters or numbers and the library does not yet: first, last (fixed values).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
#: PATTERN with those neither letters nor numbers; it is slower, and for texts that have one.
CAREFUL = "(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{_NEWER}]").replace(r"\p{L}+", rf"[\p{{L}}--{_NEWER}]+").replace(r"\p{N}+", rf"[\p{{N}}--{_NEWER}]+")
#: The characters below U+0100 that are letters, numbers and white space, for a pattern of the standard library's, which is faster where texts have no others.
_LATIN = {p: "".join(f"\\x{ord(c):02x}" for c in regex.findall(rf"\{p}", "".join(map(chr, range(256))))) for p in ("p{L}", "p{N}", "s")}
LATIN = PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(_LATIN.values()) + "]").replace(r"\S", rf"[^{_LATIN['s']}]").replace(r"\p{L}", f"[{_LATIN['p{L}']}]").replace(r"\p{N}", f"[{_LATIN['p{N}']}]").replace(r"\s", f"[{_LATIN['s']}]")
#: Words that the lexicon holds at most, and bytes of one: the compiled file stays below 10 MB.
LEXICON_WORDS, WORD_BYTES = 131_072, 32
#: Words of fewer occurrences in all are never in the lexicon.
LEAST_COUNT = 4
#: Distinct words that a worker counts before it passes them on, and that it remembers.
COUNTED, REMEMBERED = 400_000, 300_000
#: Bytes of texts encoded together (one text at least), and words of a text handled at a time.
GROUP_BYTES, BLOCK_WORDS = 1 << 20, 1 << 18
#: The rank of a pair that does not merge.
NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        of = byte_symbols()
        raw = lambda s: bytes(of[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        pieces: dict[int, bytes] = {v: k for k, v in ids.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids, self.first = len(ids), np.array(self.single, np.int64)
        sides = [(raw(a), raw(b)) for a, b in pairs]
        keys = np.array([ids[a] * self.ids + ids[b] for a, b in sides], np.int64)
        self.merged = np.array([ids[a + b] for a, b in sides], np.int64)  # by rank
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pieces |= {v: k.encode() for k, v in self.special.items()}
        every = [pieces.get(k, b"") for k in range(max(pieces) + 1)]
        self.piece_sizes = np.array([len(x) for x in every], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.latin, self.plain, self.careful = re.compile(LATIN), regex.compile(PATTERN), regex.compile(CAREFUL)
        self.beyond, self.newer = re.compile(r"[^\x00-\xff]").search, regex.compile(_NEWER).search

    def pattern(self, text: str):
        """What splits this text."""
        if not self.beyond(text):
            return self.latin
        return self.careful if self.newer(text) else self.plain

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.cut is None or not self.cut.search(text):
            return self.pattern(text).findall(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.pattern(part).findall(part))]

    def blocks(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """All words of `texts` in order, and how many each text has of them: one block, or for a single long text as many as its length needs."""
        if len(texts) > 1 or len(texts[0]) <= GROUP_BYTES:
            split = [self.split(t) for t in texts]
            yield list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))
            return
        parts = self.cut.split(texts[0]) if self.cut else texts
        words = chain.from_iterable([part] if k % 2 else (m[0] for m in self.pattern(part).finditer(part)) for k, part in enumerate(parts))
        while block := list(islice(words, BLOCK_WORDS)):
            yield block, np.array([len(block)])

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: of its pairs, that of least rank, then the leftmost, is merged until none has a rank. n log n in its length."""
        ids, n, get = array("i", (self.single[b] for b in word)), len(word), self.rank_of.get
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank = lambda k: get(ids[k] * self.ids + ids[after[k]]) if after[k] < n else None
        # A rank and a place in one number; a place's pair may have changed since.
        heap = [found << 40 | k for k in range(n - 1) if (found := rank(k)) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            k = top & (1 << 40) - 1
            if ids[k] < 0 or rank(k) != top >> 40:
                continue
            j = after[k]
            ids[k], ids[j] = int(self.merged[top >> 40]), -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for i in (before[k], k):
                if i >= 0 and (found := rank(i)) is not None:
                    heappush(heap, found << 40 | i)
        return [i for i in ids if i >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not merge."""
        key = a * self.ids + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of each word, one after another, and how many ids each has; all but long words take a step at a time together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES)).tolist()
        long = {k: self.merge(words[k]) for k in np.flatnonzero(lengths > WORD_BYTES).tolist()}
        counts = np.zeros(len(words), np.int64)
        ids, word = self._merge_short([words[k] for k in short])
        counts[short] = np.bincount(word, minlength=len(short))
        if not long:
            return ids, counts
        counts[list(long)] = [len(x) for x in long.values()]
        starts, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
        inner = counts[short]
        out[np.repeat(starts[short] - (np.cumsum(inner) - inner), inner) + np.arange(len(ids))] = ids
        for k, x in long.items():
            out[starts[k] : starts[k] + len(x)] = x
        return out, counts

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and of each id which word it is of."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank = np.full(len(ids), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while True:
            best = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))))
            at = np.flatnonzero((rank == best[word]) & (rank != NONE))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))] if len(at) else at
            if not len(at):
                break
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            ids, rank, word = ids[keep], rank[keep], word[keep]
            for k in (place, place[place > 0] - 1):
                inner = np.zeros(len(k), bool)
                within = k + 1 < len(ids)
                inner[within] = word[k[within]] == word[k[within] + 1]
                rank[k] = NONE
                rank[k[inner]] = self.ranks(ids[k[inner]], ids[k[inner] + 1])
        return ids, word

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.piece_sizes[ids]
        shift = np.repeat(self.piece_starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.piece_bytes[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary_of(text: str) -> Vocabulary:
    """The vocabulary of a file's text, made once in a process."""
    return Vocabulary(text)


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer from words to ids, as one block of bytes that Lexicon maps."""
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []  # of each finished state
    finals: list[bool] = []

    def finished(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(key[1])
            finals.append(key[0])
        return register[key]

    # A node on the path of the last word: [final, [(label, finished state)...]]; only that path can still change.
    path: list[list] = [[False, []]]
    labels: list[int] = []
    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(labels)) and labels[common] == word[common]:
            common += 1
        while len(labels) > common:
            node = path.pop()
            path[-1][1].append((labels.pop(), finished(node)))
        for b in word[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        node = path.pop()
        path[-1][1].append((labels.pop(), finished(node)))
    root = finished(path[0])

    counts = np.zeros(len(edges), np.int64)  # words from a state; edges lead to states finished before
    keys, targets, skips = [], [], []
    for s, out in enumerate(edges):
        n = int(finals[s])
        for label, to in out:
            keys.append(s * 256 + label)
            targets.append(to)
            skips.append(n)
            n += int(counts[to])
        counts[s] = n
    ids = [words[w] for w in ordered]
    parts = [
        np.array([root], np.int64),
        np.array(finals, np.int64),
        np.array(keys, np.int64),
        np.array(targets, np.int64),
        np.array(skips, np.int64),
        np.cumsum([0, *map(len, ids)], dtype=np.int64),
        np.fromiter(chain.from_iterable(ids), np.int64),
    ]
    return np.concatenate([np.array([len(parts), *map(len, parts)], np.int64), *parts]).astype(np.int32).tobytes()


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str):
        block = np.memmap(path, np.int32, "r")
        lengths = block[1 : 1 + block[0]].tolist()
        at, parts = 1 + len(lengths), []
        for n in lengths:
            parts.append(block[at : at + n])
            at += n
        self.root, self.final, self.keys, self.targets, self.skips, self.starts, self.ids = parts
        self.root = int(self.root[0])

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon; all words take a step at a time. A word's ids are ids[starts[number] : starts[number + 1]]."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        state[sizes > WORD_BYTES] = -1
        for k in range(int(min(sizes.max(initial=0), WORD_BYTES))):
            on = np.flatnonzero((state >= 0) & (sizes > k))
            key = state[on] * 256 + text[starts[on] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(on), bool)
            state[on] = np.where(hit, self.targets[at] if len(self.keys) else -1, -1)
            number[on] += self.skips[at] if len(self.keys) else 0
        found = (state >= 0) & (self.final[state] == 1)
        return np.where(found, number, -1)


@lru_cache(maxsize=1)
def lexicon_of(name: str) -> Lexicon:
    """The lexicon that ship_lexicon() sent to this executor under `name`, mapped once in a process."""
    return Lexicon(SparkFiles.get(name))


class _Numbers(dict):
    """Words to numbers; a word that is new gets the next."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each start and size, one after another."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Ids of texts: remembered words first, then the lexicon, then exact merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()  # a word's number; its ids are those from starts[number] on
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self) -> None:
        """Ids of the words that got a number since the last time."""
        fresh, self.known.fresh = self.known.fresh, []
        raw = [w.encode("utf-8", "replace") for w in fresh]
        number = self.lexicon.lookup(raw)
        special = self.vocabulary.special
        if special:
            number[[k for k, w in enumerate(fresh) if w in special]] = -2
        seen, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number == -1)
        sizes = np.ones(len(fresh), np.int64)
        sizes[seen] = self.lexicon.starts[number[seen] + 1] - self.lexicon.starts[number[seen]]
        merged, sizes[unseen] = self.vocabulary.merge_all([raw[k] for k in unseen])
        tokens = [special[fresh[k]] for k in np.flatnonzero(number == -2)]
        starts = np.zeros(len(fresh), np.int64)
        at = len(self.flat)
        for k in (seen, unseen, np.flatnonzero(number == -2)):
            starts[k] = at + np.cumsum(sizes[k]) - sizes[k]
            at += int(sizes[k].sum())
        found = _gather(self.lexicon.ids, self.lexicon.starts[number[seen]].astype(np.int64), sizes[seen])
        self.flat = np.concatenate((self.flat, found, merged.astype(np.int32), np.array(tokens, np.int32)))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        values, counts = [], np.zeros(len(texts), np.int64)
        for words, of_text in self.vocabulary.blocks(texts):
            if len(self.known) > REMEMBERED:
                self.forget()
            number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            if self.known.fresh:
                self.learn()
            sizes = self.sizes[number]
            values.append(_gather(self.flat, self.starts[number], sizes))
            upto = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.cumsum(of_text)
            counts += upto[ends] - upto[ends - of_text]
        return np.concatenate([np.zeros(0, np.int32), *values]), counts


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def build_lexicon(docs: DataFrame, text_col: str, vocabulary: str, words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of all texts, `words` at most, special tokens, rare and long words apart."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = vocabulary_of(spec.value), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for at, n in text_groups(batch.column(0), GROUP_BYTES):
                for found, _ in model.blocks([x or "" for x in batch.column(0)[at : at + n].to_pylist()]):
                    seen.update(found)
                    if len(seen) > COUNTED:
                        yield flush()
                        seen.clear()
        yield flush()

    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    totals = counts.filter(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    totals = materialize(totals.withColumn("bin", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    # From the bins of counts (a few hundred), the least count with which all words from there on fit.
    left, least = words, 1 << 20
    for row in sorted(totals.groupBy("bin").agg(F.count("*").alias("words")).collect(), reverse=True):
        if row.words > left:
            break
        left, least = left - row.words, row.bin
    found = [row.word for row in totals.filter(F.col("bin") >= least).select("word").collect()]  # at most `words`
    forget(totals)
    model = vocabulary_of(vocabulary)
    raw = [w.encode() for w in found if w not in model.special]
    ids, sizes = model.merge_all(raw)
    ends = np.cumsum(sizes).tolist()
    flat = ids.tolist()
    return compile_lexicon({w: tuple(flat[a:b]) for w, a, b in zip(raw, [0, *ends], ends)})


def ship_lexicon(spark: SparkSession, block: bytes) -> str:
    """Send a compiled lexicon to every executor, once each, under a name by its digest; the name."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:32]}"
    if not any(f.endswith("/" + name) for f in spark.sparkContext.listFiles):
        path = f"{new_path(spark, 'lexicon')}/{name}"
        write_bytes(spark, path, block)
        spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", words: int = LEXICON_WORDS, decoded_col: str | None = None) -> DataFrame:
    """docs with `ids_col`, the ids of each whole text (array of int), as the tokenizers library gives them without added tokens.

    With decoded_col, that column holds what decode() makes of the ids, in the same pass. The strings of special tokens
    are those tokens, as there. Null text is empty and has no ids. The vocabulary's path is read on the driver. Columns of
    docs named `ids_col` or decoded_col are replaced; others are passed on. No rows give no rows.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = ship_lexicon(docs.sparkSession, build_lexicon(docs, text_col, vocabulary, words))
    p = prefix(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary_of(spec.value)
        encoder = Encoder(model, lexicon_of(name))
        for whole in batches:
            for at, n in text_groups(whole.column(whole.num_columns - 1), GROUP_BYTES):
                *rest, texts = whole.slice(at, n).columns
                values, counts = encoder.encode([x or "" for x in texts.to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(counts)))
                made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]
                if decoded_col is not None:
                    made.append(pa.array([model.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*rest, *made], names=out.names)

    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col is not None else [])]
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)]
    out = T.StructType([*kept, *made])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias(p + "text")).mapInArrow(run, out)


def decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with `text_col`, the text of each row's ids, special tokens included; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    spec = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary_of(spec.value)
        for whole in batches:
            for at, n in text_groups(whole.column(whole.num_columns - 1), GROUP_BYTES):
                batch = whole.slice(at, n)
                texts = [model.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else []) for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=out.names)

    kept = [f for f in rows.schema.fields if f.name != text_col]
    out = T.StructType([*kept, T.StructField(text_col, T.StringType())])
    p = prefix(rows)
    return rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{ids_col}`").alias(p + "ids")).mapInArrow(run, out)


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs: its text encoded, and the ids decoded again."""
    rows = encode(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), vocabulary_path, decoded_col="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
