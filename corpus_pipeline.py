"""Corpus pipeline: stages over ``documents``, each written and read again.

Rejected documents and all but one of each group of near-duplicates leave; the last stage
gives the places of all remaining tokens in training sequences. Each stage takes null and
empty values, repeated rows, extra columns and empty tables as its operator says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postgeo.llm import jaccard, langid, packing, quality
from postgeo.session import cut_lineage, scratch_path

#: A language is believed from this chance on.
LANGUAGE_CHANCE = 0.5
#: No stage but the first part of the third can be written in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    judged = quality.judge(docs, labels, F.col("source"), F.col("lang"), prefix="_quality_")
    return judged.where("_quality_kept").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go."""
    model = langid.train(docs, "text", "lang", ~langid.held_out("doc_id"))
    told = langid.predict(docs, "text", model, "_told", "_chance")
    if model.languages:
        told = told.where((F.col("_told") != langid.UNKNOWN) & (F.col("_chance") >= LANGUAGE_CHANCE))
    return told.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first row; rows without a word stay.

    The numbers depend on how a scan is split, so the numbered rows are written once.
    """
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.near_duplicates(rows, "__row", "text")
    kept = groups.where(F.col("__row") == F.col("component_id")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of all documents, placed in sequences."""
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_ones), ("language ID", known_language), ("n-gram Jaccard join", one_of_each), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
