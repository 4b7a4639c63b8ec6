"""A copy of the postings in map order, and the files that a map request has to read.

Files follow the Z-curve, so each covers a small area; ``zones`` holds the box of every file.
A request picks its files from there before Spark lists or opens any other.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as X, geo
from ..operators import search
from .tables import metadata_only

FILE_ROWS = 500_000
#: Files that are named one by one; a request that touches more reads the folder, where the
#: box prunes by the statistics of each file.
NAMED = 2_000


def publish(jobs: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """Write the copy. Rows without a place answer no map request and are left out. Rows of one
    point are split among files by id, so a crowded point makes no file large."""
    located = metadata_only(jobs).where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    files = max(1, -(-located.count() // file_rows))
    key = geo.curve_key(F.col("lat"), F.col("lng"), X.ZOOM_MAX)
    located.withColumn("_key", key).repartitionByRange(files, "_key", "id").sortWithinPartitions("_key", "id").drop("_key").write.mode(
        "errorifexists"
    ).parquet(f"{root}/rows")
    sides = [f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("min", F.min), ("max", F.max))]
    rows = jobs.sparkSession.read.parquet(f"{root}/rows")
    rows.groupBy(F.input_file_name().alias("file")).agg(*sides, F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{root}/zones")


def _rows(spark: SparkSession, root: str, touched: Column) -> DataFrame:
    """Rows of the files whose box meets the condition."""
    files = [unquote(r.file) for r in spark.read.parquet(f"{root}/zones").where(touched).select("file").limit(NAMED + 1).collect()]
    if len(files) > NAMED:
        return spark.read.parquet(f"{root}/rows")
    whole = spark.read.parquet(f"{root}/rows") if not files else None
    return whole.limit(0) if whole is not None else spark.read.parquet(*files)


def _meets(south: float, north: float, west: float, east: float) -> Column:
    return (F.col("max_lat") >= south) & (F.col("min_lat") <= north) & (F.col("max_lng") >= west) & (F.col("min_lng") <= east)


def rows_in_box(spark: SparkSession, root: str, min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> DataFrame:
    """Rows of the files that a box touches (and others of these files)."""
    return _rows(spark, root, _meets(min_lat, max_lat, min_lng, max_lng))


def rows_around(spark: SparkSession, root: str, lat: float, lng: float, radius_km: float) -> DataFrame:
    """Rows of the files that a circle may touch."""
    (south, north), sides = geo.circle_box(float(lat), float(lng), float(radius_km))
    touched = F.lit(False)
    for west, east in sides:
        touched = touched | _meets(south, north, west, east)
    return _rows(spark, root, touched)


def viewport(spark: SparkSession, root: str, box: tuple[float, float, float, float], filters: search.Filters = search.Filters(), limit: int = X.LIMIT_DEFAULT) -> DataFrame:
    """``search.viewport`` on the copy."""
    return search.viewport(rows_in_box(spark, root, *box), *box, filters, limit)


def nearby(spark: SparkSession, root: str, center: tuple[float, float, float], filters: search.Filters = search.Filters(), limit: int = X.LIMIT_DEFAULT) -> DataFrame:
    """``search.nearby`` on the copy; ``center``: lat, lng, radius in km."""
    return search.nearby(rows_around(spark, root, *center), *center, filters, limit)
