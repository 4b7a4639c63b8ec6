"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, digest, divergence, images, jaccard, langid, licenses, negatives, packing, quality, sharding, spelling, urls

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_paragraphs", F.size("spans").cast("long").alias("n_license_paragraphs"),
        F.array_join("families", ",").alias("families"), F.array_max("spans.chance").alias("chance"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, "text", *ranks, decoded="decoded").select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
        special=packing.added_tokens(public_tokenizers.path(TOKENIZER)),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no address: the source stands for the host, the language for the path."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.judge(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.drop("text", "source", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(_table(spark, sf_dir, "documents"))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each page gets one: a quarter of them shows a scene of
    the page's host, the others one shared by two neighbouring pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urls.url_parts(F.col("url"))
    own = F.xxhash64(F.lit("page"), F.floor(F.col("page_id") / 2))
    scene = F.when(F.pmod(F.xxhash64("url"), F.lit(4)) == 0, F.xxhash64(F.lit("host"), host)).otherwise(own)
    return images.copies(images.lead_images(pages, "page_id", scene), "page_id", "image")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_table(spark, sf_dir, "documents")))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edit_likeness(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
