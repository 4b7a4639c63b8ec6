"""Columns shown to a reader of a posting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X


def _filled(c: Column) -> Column:
    """A number that counts as present: neither NULL nor 0."""
    return F.coalesce(c, F.lit(0)) != 0


def wage_label(lo: Column, hi: Column) -> Column:
    a, b = lo.cast("string"), hi.cast("string")
    return (
        F.when(_filled(lo) & _filled(hi), F.concat(F.lit("$"), a, F.lit(" - $"), b, F.lit("/hr")))
        .when(_filled(lo), F.concat(F.lit("$"), a, F.lit("+/hr")))
        .when(_filled(hi), F.concat(F.lit("Up to $"), b, F.lit("/hr")))
        .otherwise(F.lit(X.LABEL_NO_WAGE))
    )


def distance_label(km: Column) -> Column:
    finite = km.isNotNull() & ~F.isnan(km) & (F.abs(km) < float("inf"))
    return F.when(finite, F.format_string("%.1fkm", km)).otherwise(F.lit(""))


def age_label(posted_at: Column, now: Column) -> Column:
    """Age in words; a date in the future gives a negative number of days."""
    secs = F.unix_micros(now.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp"))
    days = F.floor(secs / F.lit(86400000000.0))

    def words(n, unit):
        return F.concat(n.cast("bigint").cast("string"), F.lit(unit))

    return (
        F.when(posted_at.isNull(), F.lit(""))
        .when(days == 0, F.lit(X.LABEL_TODAY))
        .when(days == 1, F.lit(X.LABEL_YESTERDAY))
        .when(days < 7, words(days, X.LABEL_DAYS))
        .when(days < 30, words(F.floor(days / 7), X.LABEL_WEEKS))
        .otherwise(words(F.floor(days / 30), X.LABEL_MONTHS))
    )


def date_label(posted_at: Column) -> Column:
    d = F.concat(
        F.year(posted_at).cast("string"), F.lit("년 "),
        F.month(posted_at).cast("string"), F.lit("월 "),
        F.dayofmonth(posted_at).cast("string"), F.lit("일"),
    )
    return F.coalesce(d, F.lit(X.LABEL_NO_DATE))


def coordinate_label(lat: Column, lng: Column) -> Column:
    return F.when(mappable(lat, lng), F.format_string("%.6f, %.6f", lat, lng)).otherwise(F.lit(""))


def mappable(lat: Column, lng: Column) -> Column:
    """Both coordinates present and neither of them 0."""
    return (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lng, F.lit(0.0)) != 0)


def _band(c: Column, steps, low) -> Column:
    out = None
    for at_least, value in steps:
        out = F.when(c >= at_least, F.lit(value)) if out is None else out.when(c >= at_least, F.lit(value))
    return out.otherwise(F.lit(low))


def confidence_label(c: Column) -> Column:
    return _band(c, X.CONFIDENCE_LABELS, X.CONFIDENCE_LABEL_LOW)


def confidence_color(c: Column) -> Column:
    return _band(c, X.CONFIDENCE_COLORS, X.CONFIDENCE_COLOR_LOW)


def title_label(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(X.LABEL_NO_TITLE))


def low_confidence(c: Column) -> Column:
    return c < X.LOW_CONFIDENCE_BELOW
