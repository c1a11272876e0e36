"""The registered queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.llm import (
    cover_tree, exact_dedup, importance, language, licences, merkle, mixing, near_dedup,
    pieces, quality, resharding, toxicity, unigram, warc,
)
from tripmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# A public piece model; another path can be given to the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = 16


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.place(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("row.doc_id", "source", "share", "block", "slot", "position")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, pieces.load(PIECES)))


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one shard per source (by a hash of its name), which are as uneven as the
    sources, to even ones."""
    docs = table(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % SHARDS
    placed, _ = resharding.assign(resharding.sized(docs, old), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"), pieces.load(PIECES))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("chunks")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_reshard": op4_reshard,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_dedup": op6_near_dedup,
    "op7_warc": op7_warc,
    "op8_licence_scan": op8_licence_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_top_k_search": op13_top_k_search,
}
