"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgeo.session import cut_lineage

#: Rows per numbering cell; the number of cells follows the number of rows.
CELL_ROWS = 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score for ``key``.

    A shard's score depends on key, shard and its weight only, so a new shard takes rows
    into itself and moves none between the others; a shard's share follows its weight.
    A null key is a key like any other. Equal scores go to the lower shard.
    """
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("shards need positive, finite weights")
    scores = []
    for s, w in enumerate(weights):
        # 53 bits make a uniform number within (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
        # -w / ln(u) has its maximum where ln(u) / w has
        scores.append(F.struct((F.ln(u) / F.lit(float(w))).alias("score"), F.lit(-s).alias("s")))
    return (-F.greatest(*scores, scores[0])["s"]).cast("int")


def assign(
    docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) per row.

    size is the UTF-8 length of the text (null: none) plus 8; ``grown_shard`` is the shard
    with one more of mean weight. ``slot`` numbers a shard's rows from 0 without gaps: rows
    get a place within a random cell of the shard, and cells a running offset, so no task
    holds a shard. Rows with equal keys, also null ones and repeated rows, share a shard
    and have slots of their own. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    placed = cut_lineage(
        docs.select(
            F.col(id_col).alias("_key"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), shard_of(F.col(id_col), weights).alias("shard"),
            shard_of(F.col(id_col), grown).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"),
        ),
        "shards",
    )
    cells = max(1, -(-placed.count() // (CELL_ROWS * len(weights))))
    in_cell = Window.partitionBy("shard", "_cell").orderBy("_row")
    numbered = cut_lineage(
        placed.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells)))
        .withColumn("_n", F.row_number().over(in_cell)),
        "numbered",
    )
    counts = cut_lineage(numbered.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_count")), "cells")
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, ["shard", "_cell"]).select(
        F.col("_key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_offset") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard",
    )
