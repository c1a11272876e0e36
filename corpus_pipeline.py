"""From raw documents to token ids: quality rules, exact and near duplicates, mixing
sources to target weights, SentencePiece encoding.

Each stage takes all documents that its predecessor kept and returns whole rows with the
columns of documents; the last returns the ids. Mixing keeps every row: its decision is
the order in which the rows, and so the files written from them, come by name. Encoding
takes the order from there: its rows have the position in the mix at which they are trained on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tripmill.llm import catalog, exact_dedup, mixing, near_dedup, pieces, quality, unigram
from tripmill.llm.common import cut, remove_folder, shared_folder, table

# Learned thresholds, hashed orders and token ids: SQL can't express the stages, so the
# tests compare each with a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.read_back(docs).select("row.doc_id", "row.text", "position")
    return unigram.encode(placed, pieces.load(catalog.PIECES), "position")


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written as Parquet in the shared folder and read
    again as the next one's documents; a lost executor costs no earlier stage. The files go
    when the result, which is kept as a checkpoint, is there."""
    docs = table(spark, sf_dir, "documents")
    work = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{work}/{name}")
            docs = spark.read.parquet(f"{work}/{name}")
        return cut(docs)
    finally:
        remove_folder(spark, work)
