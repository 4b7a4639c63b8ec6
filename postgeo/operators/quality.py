"""Review queue, corrections, take-downs, favourites, key figures, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, labels


def review_queue(jobs: DataFrame) -> DataFrame:
    """Postings with a doubtful place, least certain first."""
    return (
        jobs.where(F.col("confidence") < X.REVIEW_BELOW)
        .select(
            F.col("id").alias("job_id"), F.lit("low_confidence").alias("reason"), "confidence",
            "lat", "lng", F.lit("pending").alias("status"),
        )
        .orderBy("confidence", "job_id")
    )


def apply_review(jobs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Approved corrections move the point; everything else stays."""
    fixes = corrections.where(F.col("status") == "approved").select(
        F.col("job_id").alias("id"), "suggested_lat", "suggested_lng"
    )
    moved = F.col("suggested_lat").isNotNull() & F.col("suggested_lng").isNotNull()
    return (
        jobs.join(fixes, "id", "left")
        .withColumn("lat", F.when(moved, F.col("suggested_lat")).otherwise(F.col("lat")))
        .withColumn("lng", F.when(moved, F.col("suggested_lng")).otherwise(F.col("lng")))
        .withColumn("reviewed", moved)
        .drop("suggested_lat", "suggested_lng")
    )


def review_history(jobs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Log rows of settled items: old and new point, or the reason of a hold."""
    settled = corrections.where(F.col("status").isin("approved", "hold"))
    approved = F.col("status") == "approved"
    return settled.join(jobs.select(F.col("id").alias("job_id"), "lat", "lng"), "job_id").select(
        "job_id", "status", "reason", F.col("lat").alias("old_lat"), F.col("lng").alias("old_lng"),
        F.when(approved, F.col("suggested_lat")).alias("new_lat"),
        F.when(approved, F.col("suggested_lng")).alias("new_lng"),
    )


HOST_SALTS = 64


def remove_blocked(jobs: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Take-downs by address or by host. An address without a readable host stays.

    One host may hold most postings: each blocked host stands once per salt, so its
    postings meet it in as many places.
    """
    urls = blocklist.where(F.col("source_url").isNotNull()).select("source_url").distinct()
    hosts = blocklist.where(F.col("host").isNotNull()).select(F.col("host").alias("_host")).distinct()
    salted = hosts.select("_host", F.explode(F.array(*[F.lit(i).cast("long") for i in range(HOST_SALTS)])).alias("_salt"))
    return (
        jobs.join(urls, "source_url", "left_anti")
        .withColumn("_host", F.try_parse_url("source_url", F.lit("HOST")))
        .withColumn("_salt", F.pmod(F.xxhash64("source_url"), F.lit(HOST_SALTS)))
        .join(salted, ["_host", "_salt"], "left_anti")
        .select(*jobs.columns)
    )


def favorites(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """Saved postings of every user."""
    return marks.select("user_id", F.col("job_id").alias("id")).distinct().join(jobs, "id")


def category_counts(jobs: DataFrame) -> DataFrame:
    """Postings per category of the vocabulary, also where there are none."""
    spark = jobs.sparkSession
    words = spark.createDataFrame(
        [(i, v, t) for i, (v, t) in enumerate(X.CATEGORY_LABELS, start=1)], "prio INT, category STRING, label STRING"
    )
    n = jobs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return words.join(n, "category", "left").select(
        "prio", "category", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def confidence_kpi(jobs: DataFrame) -> DataFrame:
    """Mean confidence per region and overall (is_total = 1)."""
    return jobs.rollup("region_hint").agg(
        F.grouping("region_hint").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("jobs"), F.avg("confidence").alias("mean_confidence"),
    )


def present(jobs: DataFrame, now: Column) -> DataFrame:
    """Display columns of a result list; ``distance_km`` may be missing."""
    c = F.col
    km = c("distance_km") if "distance_km" in jobs.columns else F.lit(None).cast("double")
    return jobs.select(
        "id",
        labels.title_label(c("title")).alias("title_label"),
        labels.wage_label(c("wage_min"), c("wage_max")).alias("wage_label"),
        labels.low_confidence(c("confidence")).alias("low_confidence"),
        labels.confidence_label(c("confidence")).alias("confidence_label"),
        labels.confidence_color(c("confidence")).alias("confidence_color"),
        labels.distance_label(km).alias("distance_label"),
        labels.age_label(c("posted_at"), now).alias("age_label"),
        labels.date_label(c("posted_at")).alias("date_label"),
        labels.coordinate_label(c("lat"), c("lng")).alias("coordinate_label"),
    )
