"""Region table: listing, seed, address clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as X
from ..sources import schemas

# fixed values: seed boards (city, board, centre city)
SEED_BOARDS = [
    ("Vancouver", 4, "Vancouver"), ("Victoria", 62, "Victoria"), ("Toronto", 53, "Toronto"),
    ("Vancouver", 56, "Vancouver"), ("Other Cities", 59, "Vancouver"),
]
OTHER_BOARD = 59
HOME_BOARD, HOME_CITY = 4, "Vancouver"


def seed_regions(spark: SparkSession, host: str) -> DataFrame:
    centers = {c: (a, b) for c, a, b in X.CITY_CENTERS}
    rows = [
        (i, city, bbs, f"{host}/listing.php?bbs={bbs}", centers[center])
        for i, (city, bbs, center) in enumerate(SEED_BOARDS, start=1)
    ]
    return spark.createDataFrame(rows, schemas.REGIONS)


def list_regions(regions: DataFrame) -> DataFrame:
    return regions.select("id", "city", "bbs", "listing_url").orderBy("id")


def rewrite_host(url: Column, old: str, new: str) -> Column:
    """Swap the host once, only at the start of the address."""
    return F.when(url.startswith(old), F.concat(F.lit(new), F.substring(url, F.lit(len(old) + 1), F.length(url)))).otherwise(url)


def migrate(regions: DataFrame, old_hosts: list[str], new_host: str) -> DataFrame:
    """Bring listing addresses to the new host, name the home board, add the
    board for other cities when it is missing."""
    url = F.col("listing_url")
    for old in old_hosts:
        url = F.replace(url, F.lit(f"{old}/listing.php"), F.lit(f"{new_host}/listing.php"))
    city = F.when(F.col("bbs") == HOME_BOARD, F.lit(HOME_CITY)).otherwise(F.col("city"))
    fixed = regions.withColumn("listing_url", url).withColumn("city", city)
    lat, lng = next((a, b) for c, a, b in X.CITY_CENTERS if c == HOME_CITY)
    missing = (
        regions.agg(
            (F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id"),
            F.count_if(F.col("bbs") == OTHER_BOARD).alias("n"),
        )
        .where("n = 0")
        .select(
            "id", F.lit("Other Cities").alias("city"), F.lit(OTHER_BOARD).alias("bbs"),
            F.lit(f"{new_host}/listing.php?bbs={OTHER_BOARD}").alias("listing_url"),
            F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng")).alias("center"),
        )
    )
    return fixed.select("id", "city", "bbs", "listing_url", "center").unionByName(missing)
