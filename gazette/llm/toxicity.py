"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which its label tells only whether one or more are toxic. A sentence's chance p is
logistic in the summed weights of its words' features; a document's is the noisy-or of its sentences, 1 - prod(1 - p).
The weights are fitted to document labels through the noisy-or, so that sentences get scores though none has a label,
and the sentences that a document's score rests on are located by them. A word's features are itself and the beginnings
of it, and the character runs within it; features are chosen by how their document frequencies differ.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prefix, quoted

#: Labelled documents of each class that the classifier is fitted on, at most; chosen by a hash of the identifier.
TRAINED = 2_500
#: Features that the model keeps, the training documents that one must occur in, and by how many standard deviations its document frequencies must differ.
FEATURES, LEAST_DOCS, LEAST_Z = 4_000, 3, 2.5
#: Documents of a score from here on count as toxic, and sentences from here on are located.
THRESHOLD = 0.3
#: Documents with this remainder of crc32(doc_id) by 4 are held out.
HELD_OUT = 2
SENTENCE = re.compile(r"[^.!?\n]+")
REMEMBERED = 400_000


#: Features are numbers below this, hashes of what they are: counts of them take fixed memory.
HASHED = 1 << 22


def features(word: str) -> set[int]:
    """Of a word in lower case without the punctuation around it: itself, its beginnings of 4 to 6 characters, its runs of 5."""
    w = word.lower().strip(",;:|\"'()[]{}*#$%&<>-")
    if not w:
        return set()
    names = [w, *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n), *(f"~{w[k : k + 5]}" for k in range(1, len(w) - 5))]
    return {xxhash.xxh32_intdigest(n.encode("utf-8", "replace")) % HASHED for n in names}


class Model:
    """Weights of features, the bias of a sentence; `constant` is the score of every document where there was nothing to learn from."""

    def __init__(self, weights: dict[int, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            get = self.weights.get
            found = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def sentences(self, text: str) -> list[float]:
        known, word = self.known, self.word
        return [self.bias + sum(known[w] if w in known else word(w) for w in set(s.split())) for s in SENTENCE.findall(text)]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end and score of the sentences that have THRESHOLD or more."""
        if self.constant is not None:
            return self.constant, []
        logits = self.sentences(text)
        # log(1 - p) of a sentence is -log(1 + e^x)
        score = -math.expm1(-sum(math.log1p(math.exp(min(x, 30.0))) for x in logits))
        least = math.log(THRESHOLD / (1 - THRESHOLD))
        where = []
        if logits and max(logits) >= least:
            where = [(*m.span(), 1 / (1 + math.exp(-x))) for m, x in zip(SENTENCE.finditer(text), logits, strict=True) if x >= least]
        return min(max(score, 0.0), 1.0), where


def fit(texts: list[str], labels: list[int], prior: float | None = None, steps: int = 300, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Fit to documents' labels. prior: the share of label 1 among all labelled documents, where the texts are not drawn so."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, float(y.mean()) if len(y) else 0.0)
    number_of: dict[str, int] = {}
    # Of each document, a sentence's number and a word's for each distinct word of a sentence.
    bags = []
    for text in texts:
        pairs = [(k, number_of.setdefault(w, len(number_of))) for k, s in enumerate(SENTENCE.findall(text)) for w in set(s.split())]
        bags.append(np.array(pairs, np.int32).reshape(-1, 2))
    of_words = [sorted(features(w)) for w in number_of]
    flat = np.fromiter((f for fs in of_words for f in fs), np.int32)
    ends = np.cumsum([0, *map(len, of_words)])
    del number_of, of_words

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each feature of each of `words`: the place in words, and the feature."""
        sizes = ends[words + 1] - ends[words]
        at = np.repeat(np.arange(len(words)), sizes)
        return at, flat[np.arange(len(at)) + np.repeat(ends[words] - (np.cumsum(sizes) - sizes), sizes)]

    in_docs = np.zeros((2, HASHED), np.int32)
    for bag, label in zip(bags, labels, strict=True):
        in_docs[label, np.unique(spread(np.unique(bag[:, 1]))[1])] += 1
    n0, n1 = np.sum(y == 0), np.sum(y == 1)
    usable = np.flatnonzero(in_docs.sum(axis=0) >= LEAST_DOCS)
    both = in_docs[:, usable].sum(axis=0) / (n0 + n1)
    # How far document frequencies are apart, in standard deviations.
    apart = np.abs(in_docs[1, usable] / n1 - in_docs[0, usable] / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n0 + 1 / n1))
    order = np.lexsort((usable, -apart))
    chosen = usable[order[apart[order] >= LEAST_Z][:FEATURES]]
    number = np.full(HASHED, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rows, cols, doc_of, n = [], [], [], 0
    for d, bag in enumerate(bags):
        at, f = spread(bag[:, 1])
        known = number[f] >= 0
        rows.append(n + bag[at[known], 0])
        cols.append(number[f[known]])
        sentences = int(bag[:, 0].max(initial=0)) + 1
        doc_of.append(np.full(sentences, d))
        n += sentences
    rows, cols, doc_of = (np.concatenate(x).astype(np.int64) for x in (rows, cols, doc_of))
    share = float(y.mean())
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w, bias = np.zeros(len(chosen)), -math.log(max(len(doc_of) / len(y), 1.0)) - 3.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        x = np.clip(bias + np.bincount(rows, w[cols], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-x))
        log_none = np.bincount(doc_of, -np.log1p(np.exp(x)), len(y))
        any_p = np.clip(-np.expm1(log_none), 1e-9, 1 - 1e-9)
        # d log-likelihood / d x: label 0 gives -p; label 1 gives p * (1 - P) / P.
        slope = np.where(y == 1, (1 - any_p) / any_p, -1.0) * weight
        g = slope[doc_of] * p
        grad = np.append(np.bincount(cols, g[rows], len(chosen)) / len(y) - decay * w, g.sum() / len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    return Model({f: float(x) for f, x in zip(chosen.tolist(), w, strict=True) if abs(x) > 1e-3}, float(bias))


def held_out(ident: Column) -> Column:
    """Whether a row is held out, by its identifier as text (null: empty)."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINED) -> Model:
    """Fit on at most `most` labelled documents of each class, of those not held out; of documents with two labels, the larger counts, and null labels do not."""
    ident = F.col(f"`{id_col}`")
    marks = labels.select(ident.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    marks = marks.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * most identifiers, so it may be broadcast
    rows = docs.select(ident.alias("doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    sample = sorted((r.doc, r.text or "", r.y) for r in rows.select("doc", "text", "y").collect())
    total = sum(counts.values())
    return fit([t for _, t, _ in sample], [y for *_, y in sample], counts.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", where_col: str = "sentences") -> DataFrame:
    """docs with the score of each whole text and its offending sentences, an array of start, end (code points, end exclusive) and score.

    Null text is empty; an empty text has no sentence and scores 0. Columns of docs with the new names are replaced.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.constant))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            *rest, texts = batch.columns
            scores, where = [], []
            for text in texts:
                s, found = own.score(text.as_py() or "")
                scores.append(s)
                where.append([{"start": a, "end": b, "score": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array(where, spans)], names=out.names)

    kept = [f for f in docs.schema.fields if f.name not in (score_col, where_col)]
    sentence = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    out = T.StructType([*kept, T.StructField(score_col, T.DoubleType()), T.StructField(where_col, T.ArrayType(sentence))])
    p = prefix(docs)
    return docs.select(*quoted([f.name for f in kept]), F.col(f"`{text_col}`").cast("string").alias(p + "text")).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and sentences of each row of docs, by a model fitted to `labels` (doc_id, toxic).

    Rows that repeat score alike; extra columns of either table are ignored; without labels of both classes every score is their
    mean, 0 without any. No rows give no rows.
    """
    model = train(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model)
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "sentences")
