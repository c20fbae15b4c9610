"""The corpus pipeline: quality rules, exact and near deduplication, mixing, then token ids of what is left.

Every stage but the last returns the columns of its docs, extra ones included, whatever they are called. No rows give no
rows, in any stage. Null columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.bpe import encode
from gazette.llm.common import forget, materialize
from gazette.llm.content_sort import content_sort
from gazette.llm.mixing import mixed
from gazette.llm.quality import quality_kept
from gazette.llm.simhash import simhash_kept

#: Where the box keeps the vocabulary.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the outlier distance reject go.

    Null and empty texts have too few words, so they go. Rows that repeat are judged alike and each on its own; a null
    language or source is a group like any other.
    """
    return quality_kept(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text stays.

    Null is the empty text. Of equal texts the longest original stays, then the smallest doc_id; of rows that tie in both,
    one. A text of any length is compared whole.
    """
    return content_sort(docs, carry=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest doc_id.

    Null and wordless texts have fingerprint zero and are linked like any other. A row with a null doc_id stays.
    """
    return simhash_kept(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as their source's target wants them.

    Null texts have no words and are not taken; null sources are one source, the last. One row of a source is cut at the
    words that its budget has left. Rows that repeat are rows of their own.
    """
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip (whether the ids decode to the text) of each row that is left.

    Null text is empty: no ids. Rows that repeat are encoded each. Other columns are not carried on: this is the last stage.
    """
    rows = encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The outlier estimates, the fingerprint links and BPE are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; what a stage keeps is written, and deleted once the next has been."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if k:
                forget(before)
    return docs
