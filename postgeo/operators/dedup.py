"""The same job on several boards, found by hashed contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import extract


def contact_keys(posts: DataFrame) -> DataFrame:
    """(source_url, bbs, msgid, contact): one row per distinct contact of a post.
    Only the hash is kept."""
    return posts.select(
        "source_url", "bbs", "msgid", F.explode(extract.contact_hashes(F.col("body"))).alias("contact")
    )


def contact_groups(keys: DataFrame) -> DataFrame:
    """Contacts seen on several boards: size and canonical post (smallest msgid,
    then address). Sizes and minima combine before the shuffle, so an agency
    number on a third of all posts is no hot spot."""
    return (
        keys.groupBy("contact")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.countDistinct("bbs").alias("boards"),
            F.min(F.struct("msgid", "source_url")).alias("first"),
        )
        .where("boards > 1")
        .select(
            "contact", "posts", "boards",
            F.col("first.msgid").alias("canonical_msgid"), F.col("first.source_url").alias("canonical_url"),
        )
    )


def cross_board_dups(posts: DataFrame) -> DataFrame:
    """Every post of such a group with its canonical post. Groups stay whole; each
    contact meets one row of the group table, so a large group only makes a large
    join input, which adaptive execution splits."""
    keys = contact_keys(posts)
    return keys.join(contact_groups(keys), "contact").select(
        "contact", "source_url", "bbs", "canonical_url", "posts", "boards",
        (F.col("source_url") == F.col("canonical_url")).alias("is_canonical"),
    )


def duplicate_share(posts: DataFrame) -> DataFrame:
    """1 - distinct keys / posts; the key is the smallest contact hash of a post,
    or its own address if it names no contact."""
    key = F.coalesce(F.array_min(extract.contact_hashes(F.col("body"))), F.col("source_url"))
    # two plain aggregations instead of one distinct count in a single task
    per_key = posts.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("posts"), F.count(F.lit(1)).alias("keys"),
        (1 - F.count(F.lit(1)) / F.sum("n")).alias("dup_share"),
    )
