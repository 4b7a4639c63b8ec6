"""One map request at a time: a box or a circle given as plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, geo
from ..sources.schemas import JOB_RESULT


@dataclass(frozen=True)
class Filters:
    """Optional conditions of a request; None (or an empty text) is no condition."""

    wage_min: int | None = None
    wage_max: int | None = None
    category: str | None = None
    categories: tuple[str, ...] = ()
    text: str | None = None

    def conditions(self) -> list[Column]:
        out = []
        if self.wage_min is not None:
            out.append(F.col("wage_min") >= self.wage_min)
        if self.wage_max is not None:
            out.append(F.col("wage_max") <= self.wage_max)
        if self.category:
            out.append(F.col("category") == self.category)
        if self.categories:
            out.append(F.col("category").isin(*self.categories))
        if self.text:
            out.append(F.lower("title").contains(self.text.lower()))
        return out

    def apply(self, jobs: DataFrame) -> DataFrame:
        for c in self.conditions():
            jobs = jobs.where(c)
        return jobs


def newest_first() -> list[Column]:
    """Newest posting first, undated ones before all others, ties by id."""
    return [F.col("posted_at").desc_nulls_first(), F.col("id").asc()]


def nearest_first() -> list[Column]:
    return [F.col("distance_km").asc(), F.col("id").asc()]


def viewport(
    jobs: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float,
    filters: Filters = Filters(), limit: int = X.LIMIT_DEFAULT, zoom: int | None = None,
) -> DataFrame:
    """Newest postings inside a box. ``zoom`` is accepted and has no effect.

    The box is four comparisons on plain columns, which reach the Parquet scan;
    order and limit become one TakeOrderedAndProject.
    """
    hits = jobs.where(geo.in_box(F.col("lat"), F.col("lng"), min_lng, min_lat, max_lng, max_lat))
    return filters.apply(hits).select(*JOB_RESULT).orderBy(*newest_first()).limit(limit)


def nearby(
    jobs: DataFrame, lat: float, lng: float, radius_km: float,
    filters: Filters = Filters(), limit: int = X.LIMIT_DEFAULT,
) -> DataFrame:
    """Nearest postings within a radius: ellipsoid decides who is inside, the
    sphere gives the distance shown. A box around the circle, computed from the
    request, prunes the scan first."""
    jlat, jlng = F.col("lat"), F.col("lng")
    c_lat, c_lng = F.lit(float(lat)), F.lit(float(lng))
    (south, north), sides = geo.circle_box(float(lat), float(lng), float(radius_km))
    within = F.lit(False)
    for west, east in sides:
        within = within | ((jlng >= west) & (jlng <= east))
    boxed = filters.apply(jobs.where((jlat >= south) & (jlat <= north) & within))
    hits = geo.with_ellipsoid_m(boxed, "_m", jlat, jlng, c_lat, c_lng).where(
        F.col("_m") <= radius_km * 1000.0
    )
    return (
        hits.withColumn("distance_km", geo.haversine_m(jlat, jlng, c_lat, c_lng) / 1000.0)
        .select(*JOB_RESULT, "distance_km")
        .orderBy(*nearest_first())
        .limit(limit)
    )


def sort_by_wage(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("wage_max").desc_nulls_last(), F.col("id").asc())


def mappable(jobs: DataFrame) -> DataFrame:
    """Postings that can be drawn: both coordinates present and not 0."""
    return jobs.where((F.col("lat") != 0) & (F.col("lng") != 0))
