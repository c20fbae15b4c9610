"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, chat, content_sort, mixing, periodic, quality, secrets, simhash, substring, toxicity, url_filter, warc

#: Where the box keeps the vocabulary that op7 and the pipeline use.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests_of_generations(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(own)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.paragraph_groups(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_content_sort,
        op3_secret_scan,
        op4_simhash,
        op5_chat_format,
        op6_mixing,
        op7_bpe,
        op8_warc,
        op9_toxicity,
        op10_paragraph_dedup,
        op11_centroids,
        op12_periodic_runs,
        op13_url_filter,
    )
}

#: DuckDB SQL where it can express the whole query; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_content_sort": content_sort.ORACLE_SQL,
    "op5_chat_format": chat.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op12_periodic_runs": periodic.ORACLE_SQL,
    "op13_url_filter": url_filter.ORACLE_SQL,
}
