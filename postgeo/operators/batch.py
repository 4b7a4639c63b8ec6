"""Many map requests against many postings.

A request table (one row per request) is joined to the postings through grid
cells: each request lists the few cells it touches on the level that fits its
size, each posting has one cell per level in use, and an equi-join on the cell
finds the candidates, which the exact predicate then checks. A posting has one
cell per level and a request one level, so no pair can come up twice.

Answers do not pair requests with all postings in their area (see ``pyramid``): counts
per cell say how far down its ranking a request must look, and only the postings up to
there become candidates. Within one exact point, which may hold a third of all postings
(a city centre used as fallback), the ranges of ids stand for the cells.

A hot cell with many distinct points stays an ordinary shuffle join, which adaptive
execution splits (skew join); nothing below forbids the split, since the next step is
shuffled by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, geo
from ..session import cut_lineage
from ..sources.schemas import JOB_RESULT
from . import pyramid
from .pin import pin
from .pyramid import TESTED
from .ranking import top_rows



# --- validation -------------------------------------------------------------------


def _common_ok() -> Column:
    lim = F.coalesce("lim", F.lit(X.LIMIT_DEFAULT))
    return (
        (F.coalesce("wage_min", F.lit(0)) >= 0)
        & (F.coalesce("wage_max", F.lit(0)) >= 0)
        & (lim >= 1)
        & (lim <= X.LIMIT_MAX)
    )


def check_viewports(viewports: DataFrame, need_zoom: bool = False) -> DataFrame:
    """Adds ``code``: NULL for a valid request, else the reject code."""
    bbox = (F.col("min_lng") < F.col("max_lng")) & (F.col("min_lat") < F.col("max_lat"))
    ranges = _common_ok()
    if need_zoom:
        ranges = ranges & F.coalesce(F.col("zoom").between(0, X.ZOOM_MAX), F.lit(False))
    return viewports.withColumn(
        "code",
        F.when(~F.coalesce(bbox, F.lit(False)), F.lit(X.CODE_BBOX)).when(
            ~ranges, F.lit(X.CODE_COORDINATES)
        ),
    )


def check_centers(centers: DataFrame) -> DataFrame:
    ok = (
        F.col("lat").between(-90.0, 90.0)
        & F.col("lng").between(-180.0, 180.0)
        & F.col("radius_km").between(X.RADIUS_MIN_KM, X.RADIUS_MAX_KM)
    )
    ok = F.coalesce(ok, F.lit(False)) & _common_ok()
    return centers.withColumn("code", F.when(~ok, F.lit(X.CODE_COORDINATES)))


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("code").isNotNull()).select(
        "q_id", "code", F.lit("request refused").alias("message")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return (
        checked.where(F.col("code").isNull())
        .drop("code")
        .withColumn("lim", F.coalesce("lim", F.lit(X.LIMIT_DEFAULT)))
    )


# --- exact reductions of the postings -----------------------------------------------


def group_alike(jobs: DataFrame) -> DataFrame:
    """One row per distinct tested columns, with the number of postings ``n``."""
    return jobs.groupBy(*TESTED).agg(F.count(F.lit(1)).alias("n"))


# --- the cell join ---------------------------------------------------------------------


def _with_cells(requests: DataFrame, boxes: Column) -> DataFrame:
    """One row per touched cell. ``boxes`` is an array of box structs on one level."""
    requests = pin(requests, _boxes=boxes)
    boxes = F.col("_boxes")
    cells = F.array_distinct(
        F.flatten(
            F.transform(
                boxes,
                lambda b: geo.box_cells(b["level"], b["w"], b["s"], b["e"], b["n"]),
            )
        )
    )
    return requests.select("*", boxes[0]["level"].alias("level"), F.explode(cells).alias("cell")).drop("_boxes")


def _box(level, w, s, e, n) -> Column:
    return F.struct(
        level.alias("level"), w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")
    )


def viewport_cells(viewports: DataFrame) -> DataFrame:
    w, s, e, n = (F.col(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat"))
    # postings lie on the globe, so the part of a box outside of it needs no cells
    def clip(v, bound):
        return F.greatest(F.least(v, F.lit(bound)), F.lit(-bound))

    df = pin(viewports, _w=clip(w, 180.0), _s=clip(s, 90.0), _e=clip(e, 180.0), _n=clip(n, 90.0))
    box = [F.col(c) for c in ("_w", "_s", "_e", "_n")]
    return _with_cells(df, F.array(_box(geo.box_level(*box), *box))).drop("_w", "_s", "_e", "_n")


def center_cells(centers: DataFrame) -> DataFrame:
    """Cells around each centre, as far as ``reach_km`` if there is such a column."""
    reach = F.col("reach_km" if "reach_km" in centers.columns else "radius_km")
    dlat, dlng = geo.circle_margins(F.col("lat"), reach)
    df = pin(centers, dlat=dlat, dlng=dlng)
    df = pin(
        df,
        _s=F.greatest(F.col("lat") - F.col("dlat"), F.lit(-90.0)),
        _n=F.least(F.col("lat") + F.col("dlat"), F.lit(90.0)),
        _w=F.col("lng") - F.col("dlng"),
        _e=F.col("lng") + F.col("dlng"),
    )
    w, s, e, n = (F.col(c) for c in ("_w", "_s", "_e", "_n"))
    df = pin(df, _level=geo.box_level(w, s, e, n))
    level = F.col("_level")
    low, high = F.lit(-180.0), F.lit(180.0)
    boxes = F.concat(
        F.array(_box(level, F.greatest(w, low), s, F.least(e, high), n)),
        F.when(w < low, F.array(_box(level, w + 360.0, s, high, n))).otherwise(F.array().cast(BOXES)),
        F.when(e > high, F.array(_box(level, low, s, e - 360.0, n))).otherwise(F.array().cast(BOXES)),
    )
    return _with_cells(df, boxes).drop("_w", "_s", "_e", "_n", "_level")


BOXES = "array<struct<level: int, w: double, s: double, e: double, n: double>>"


def cell_join(jobs: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """Candidate pairs. Posting columns keep their names, request columns get ``q_``.

    Postings are laid out only on the levels some request uses; that list has at
    most len(LEVEL_SIZES) rows, so broadcasting it is safe at any scale.
    """
    levels = requests.select("level").distinct()
    q = requests.select(
        "cell", *[F.col(c).alias(c if c == "q_id" else f"q_{c}") for c in requests.columns if c not in ("cell", "level")]
    )
    placed = (
        jobs.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select(*columns, F.explode(geo.point_cells(F.col("lat"), F.col("lng"))).alias("at"))
        .select(*columns, "at.level", "at.cell")
        .join(F.broadcast(levels), "level", "left_semi")
        .drop("level")
    )
    return placed.join(q, "cell").drop("cell")


def filters_hold() -> Column:
    """Optional conditions of the request row against the posting."""
    return (
        (F.col("q_wage_min").isNull() | (F.col("wage_min") >= F.col("q_wage_min")))
        & (F.col("q_wage_max").isNull() | (F.col("wage_max") <= F.col("q_wage_max")))
        & (
            (F.coalesce("q_category", F.lit("")) == "")
            | (F.col("category") == F.col("q_category"))
        )
    )


def match_viewports(jobs: DataFrame, viewports: DataFrame, columns: list[str]) -> DataFrame:
    """All (request, posting) pairs with the posting inside the box."""
    pairs = cell_join(jobs, viewport_cells(viewports), columns)
    inside = geo.in_box(
        F.col("lat"), F.col("lng"),
        F.col("q_min_lng"), F.col("q_min_lat"), F.col("q_max_lng"), F.col("q_max_lat"),
    )
    return pairs.where(inside & filters_hold())


# --- answers -------------------------------------------------------------------------------


BOX = ["min_lng", "min_lat", "max_lng", "max_lat"]
CIRCLE = ["lat", "lng", "radius_km"]
#: Shares of the postings, newest first, that boxes are answered from before all are laid out.
LEADING = [1 / 64, 1 / 8]
#: Cells on each side of a centre's own that are counted on every level.
AROUND = 2


def _by_class(columns: list[str]) -> list[Column]:
    """Columns of a class under the names that conditions on postings expect."""
    return [F.col(c).alias(c if c == "class" else f"q_{c}") for c in columns]


def _shown(pairs: DataFrame, members: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The first ``lim`` postings of every request, from those of its class."""
    return _of_members(_first_rows(pairs, order, columns), members, columns)


def _first_rows(pairs: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    ranked = top_rows(pairs, ["class"], order, X.LIMIT_MAX, F.col("id")).where(F.col("rn") <= F.col("q_lim"))
    return ranked.select("class", "q_lim", "rn", *columns)


def _of_members(ranked: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    return ranked.select("class", "rn", *columns).join(members, "class").where(F.col("rn") <= F.col("lim")).select("q_id", "rn", *columns)


def _day(posted_at: Column, ids: Column) -> Column:
    """Whole number that grows along the ranking, newest first: days back in time, before
    these, for postings without a date, the ranges of ids."""
    back = F.datediff(F.lit("9999-12-31").cast("date"), posted_at.cast("date")).cast("bigint")
    return F.when(posted_at.isNull(), ids - F.lit(1 << 62)).otherwise(back)


def viewport_keys(jobs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, cell, bucket, lim): the cells and days that can hold one of the first ``lim``
    postings of a class. ``jobs`` has a ``bucket`` that grows along the ranking.

    The counts of cells inside the box are sure; a bucket goes once those before it suffice.
    """
    cells = viewport_cells(classes)
    inside = pyramid.inside_box(F.col("level"), F.col("cell"), *[F.col(c) for c in BOX])
    cells = cut_lineage(pin(cells, inner=inside), "cells")
    hits = pyramid.met(cells, pyramid.counts(jobs, pyramid.used_of(cells), ["bucket"], cells))
    # dealt by class at once, as the window below needs it
    keys = ["class", "cell", "bucket", "gram", "lim"]
    hits = hits.select(*keys, "inner", "n").repartition("class").groupBy(*keys).agg(F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("sure"))
    earlier = Window.partitionBy("class").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("before", F.coalesce(F.sum("sure").over(earlier), F.lit(0))).where(F.col("before") < F.col("lim")).select(*keys)


def viewport_candidates(jobs: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Postings of the cells and days that ``viewport_keys`` leaves, tested."""
    asked = classes.select(*_by_class(["class", *BOX, *pyramid.CONDITIONS, "lim"]))
    keys = cut_lineage(viewport_keys(jobs, classes).drop("lim"), "keys")
    placed = (
        jobs.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select(*columns, "bucket", "gram", F.inline(geo.point_cells(F.col("lat"), F.col("lng"), pyramid.levels_of(viewport_cells(classes)))))
        .drop("level")
    )
    placed, keys = pyramid.only_asked(placed, keys), keys.join(asked, "class")
    inside = geo.in_box(F.col("lat"), F.col("lng"), *[F.col(f"q_{c}") for c in BOX])
    met = placed.join(keys, ["cell", "bucket", "gram"]).where(inside & pyramid.conditions_hold("title" in columns))
    return met.drop("cell", "bucket", "gram")


def viewport_batch(
    jobs: DataFrame, viewports: DataFrame, columns: list[str] = JOB_RESULT
) -> DataFrame:
    """Newest ``lim`` postings of every box, ranked by ``rn``.

    Besides ``category`` a request may have ``categories`` (any of these; none or empty: no
    condition) and ``text`` (contained in the title, in any letter case).
    """
    classes, members = pyramid.classes(accepted(check_viewports(viewports)), BOX)
    needed = _needed(columns, "posted_at", *_titled(viewports))
    slim = jobs.select(*needed).withColumn("bucket", _day(F.col("posted_at"), pyramid.id_range(jobs)))
    ends = slim.agg(*[F.percentile_approx("bucket", share, 1000) for share in LEADING]).first()
    slim, classes = pyramid.led_by_text(slim, classes)
    order = [F.col("posted_at").desc_nulls_first(), F.col("id").asc()]
    shown, filled = None, None
    for end in [*sorted({e for e in ends if e is not None}), None]:
        part = slim if end is None else slim.where(F.col("bucket") <= end)
        open_ = classes if shown is None else classes.join(filled, "class", "left_anti")
        if shown is not None and open_.isEmpty():
            break
        first = _first_rows(viewport_candidates(part, pyramid.dealt(open_), needed), order, columns)
        if end is None:
            shown = first if shown is None else shown.unionByName(first)
            break
        first = cut_lineage(first, "first")
        full = cut_lineage(first.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("q_lim").alias("q_lim")).where(F.col("n") >= F.col("q_lim")).select("class"), "filled")
        first = first.join(full, "class", "left_semi")
        shown, filled = (first, full) if shown is None else (shown.unionByName(first), filled.union(full))
    return _of_members(shown, members, columns)


def _center_cells(classes: DataFrame) -> DataFrame:
    """Cells of circles; ``inner`` where they lie wholly in it, ``far_km`` as a bound of their distance."""
    return _told_inner(center_cells(classes).drop("dlat", "dlng"))


def _told_inner(cells: DataFrame) -> DataFrame:
    cells = pyramid.with_reach_km(cells).drop("near_km")
    return cells.withColumn("inner", F.col("far_km") <= F.col("radius_km") * pyramid.SURE)


def _at_points(jobs: DataFrame, cells: DataFrame, extra: list[str]) -> DataFrame:
    """Points with postings in the cells, within the circle of the class, ``distance_km`` from
    its centre; ``n`` postings meet the conditions."""
    hits = pyramid.met_points(cells, pyramid.points(jobs, cells, extra))
    at = F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng")
    hits = pin(hits, distance_km=geo.haversine_m(*at) / 1000.0).where(F.col("distance_km") <= F.coalesce("reach_km", F.col("radius_km") * pyramid.DOUBT))
    close = geo.with_ellipsoid_m(hits, "_m", *at)
    return close.where(F.col("_m") <= F.col("radius_km") * 1000.0).drop("_m")


def nearby_candidates(jobs: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Postings that can be among the nearest ``lim`` of a class, tested, with ``distance_km``.

    Counts of cells wholly inside, of those around the centre on every level, give a distance
    within which there are enough; the points within it are ordered by distance, and the
    ranges of ids of one distance among themselves.
    """
    around = geo.cells_around(F.col("lat"), F.col("lng"), AROUND, F.col("radius_km") / geo.KM_PER_DEGREE)
    cells = classes.select("*", F.inline(around)).unionByName(center_cells(classes).drop("dlat", "dlng")).distinct()
    cells = cut_lineage(_told_inner(cells).where("inner"), "cells")
    sure = pyramid.met(cells, pyramid.counts(jobs, pyramid.used_of(cells), [], cells))
    upto = Window.partitionBy("class", "level").orderBy("far_km")
    reach = (
        sure.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("lim"))
        .groupBy("class").agg(F.min("far_km").alias("reach_km"))
    )
    ranged = jobs.withColumn("range", pyramid.id_range(jobs))
    # cells once more, only as far as the reach
    near = classes.join(reach, "class", "left")
    wide = center_cells(near.withColumn("whole_km", F.col("reach_km")).withColumn("reach_km", F.coalesce("reach_km", "radius_km")))
    wide = cut_lineage(wide.drop("dlat", "dlng", "reach_km").withColumnRenamed("whole_km", "reach_km"), "cells")
    keys = ["class", "p_lat", "p_lng", "range", "gram", "distance_km", *pyramid.CONDITIONS, "lim"]
    points = _at_points(ranged, wide, ["range"]).select(*keys, "n").repartition("class").groupBy(*keys).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("class").orderBy("distance_km", "range")
    peers = Window.partitionBy("class", "distance_km", "range")
    points = points.withColumn("before", F.sum("n").over(upto) - F.sum("n").over(peers)).where(F.col("before") < F.col("lim"))
    keys = points.select(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), "range", "gram", "distance_km", *_by_class(["class", *pyramid.CONDITIONS, "lim"]))
    keys = cut_lineage(keys, "keys")
    cell = geo.cell_at(0, F.col("lat"), F.col("lng"))
    close = pyramid.only_asked(ranged.select(*columns, "range", "gram", cell.alias("cell")), keys.select("gram", cell.alias("cell"))).drop("cell")
    met = close.join(keys, ["lat", "lng", "range", "gram"])
    return met.where(pyramid.conditions_hold("title" in columns)).drop("range", "gram")


def nearby_batch(
    jobs: DataFrame, centers: DataFrame, columns: list[str] = JOB_RESULT
) -> DataFrame:
    """Nearest ``lim`` postings of every circle, ranked by ``rn``; conditions as for boxes."""
    classes, members = pyramid.classes(accepted(check_centers(centers)), CIRCLE)
    needed = _needed(columns, *_titled(centers))
    slim, classes = pyramid.led_by_text(jobs.select(*needed), classes)
    pairs = nearby_candidates(slim, classes, needed)
    return _shown(pairs, members, [F.col("distance_km").asc(), F.col("id").asc()], [*columns, "distance_km"])


def _titled(requests: DataFrame) -> list[str]:
    """Column of the postings that requests with a search text need."""
    return ["title"] if "text" in requests.columns else []


def _needed(columns: list[str], *more: str) -> list[str]:
    return list(dict.fromkeys(["id", *TESTED, *more, *columns]))


def viewport_page(jobs: DataFrame, viewports: DataFrame, page_size: int) -> DataFrame:
    """Answers of ``viewport_batch`` cut into numbered pages (from 1)."""
    return viewport_batch(jobs, viewports).withColumn(
        "page", (F.floor((F.col("rn") - 1) / page_size) + 1).cast("int")
    )


def _counted(classes: DataFrame, members: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Members of classes with ``count``, ``total`` and ``matching`` from sums of ``n``."""
    found = parts[0].select("class", "n").union(parts[1].select("class", "n")).groupBy("class").agg(F.sum("n").alias("matching"))
    matching = F.coalesce("matching", F.lit(0)).cast("bigint")
    shown = F.least(matching, F.col("lim")).cast("bigint")
    return members.join(found, "class", "left").select(
        "q_id", "class", shown.alias("count"), shown.alias("total"), matching.alias("matching")
    )


def _box_counts(jobs: DataFrame, viewports: DataFrame) -> DataFrame:
    classes, members = pyramid.classes(accepted(check_viewports(viewports)), BOX)
    jobs, classes = pyramid.led_by_text(jobs, classes)
    cells = pyramid.box_pieces(viewport_cells(classes), BOX)
    inner, border = cells.where("inner"), cells.where("not inner")
    inner = pyramid.met(inner, pyramid.counts(jobs, pyramid.used_of(inner), []))
    border = pyramid.met(border, pyramid.counts(jobs, pyramid.used_of(border), ["lat", "lng"]))
    border = border.where(geo.in_box(F.col("lat"), F.col("lng"), *[F.col(c) for c in BOX]))
    return _counted(classes, members, [inner, border])


def viewport_meta(jobs: DataFrame, viewports: DataFrame) -> DataFrame:
    """Per request: rows returned (``count`` and ``total``, which are the same by
    definition) and, beyond that, all rows that match."""
    return _box_counts(jobs, viewports).drop("class")


def nearby_meta(jobs: DataFrame, centers: DataFrame) -> DataFrame:
    """Per request: counts as in ``viewport_meta``, echo of centre and radius."""
    classes, members = pyramid.classes(accepted(check_centers(centers)), CIRCLE)
    jobs, classes = pyramid.led_by_text(jobs, classes)
    cells = pyramid.circle_pieces(center_cells(classes).drop("dlat", "dlng"), pyramid.crowded(jobs))
    inner = cells.where("inner")
    inner = pyramid.met(inner, pyramid.counts(jobs, pyramid.used_of(inner), [], inner))
    border = _at_points(jobs, cells.where("not inner").withColumn("reach_km", F.lit(None).cast("double")), [])
    return _counted(classes, members, [inner, border]).join(classes.select("class", *CIRCLE), "class").select(
        "q_id", "count", "total", *CIRCLE
    )


def area_alerts(new_jobs: DataFrame, areas: DataFrame, shown: list[Column] | None = None) -> DataFrame:
    """Every (saved area, new posting) pair; ``new_jobs`` holds only created rows. Areas of equal
    box and conditions meet the postings once and are told apart only in the result.

    ``shown``: what a pair shows of its posting, made once per posting (address and place if not
    given). No pair is dealt out: the q_ids of equal areas travel as lists.
    """
    classes, members = pyramid.classes(accepted(check_viewports(areas)), BOX)
    shown = F.struct(*(shown or [F.col(c) for c in ("source_url", "lat", "lng")]))
    slim, classes = pyramid.led_by_text(new_jobs.select(*TESTED, *_titled(areas), shown.alias("shown")), classes)
    cells = cut_lineage(viewport_cells(pyramid.with_members(classes, members)), "cells")
    at = geo.point_cells(F.col("lat"), F.col("lng"), pyramid.levels_of(cells))
    placed = slim.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("*", F.inline(at)).drop("level")
    placed = cut_lineage(pyramid.only_asked(placed, cells), "placed")
    asked = cells.select("cell", "gram", "asked_by", *_by_class([*BOX, *pyramid.CONDITIONS]))
    inside = geo.in_box(F.col("lat"), F.col("lng"), *[F.col(f"q_{c}") for c in BOX])
    met = pyramid.met_evenly(placed, asked, ["cell", "gram"], "shown").where(inside & pyramid.conditions_hold("title" in placed.columns))
    return met.select("shown", F.inline("asked_by")).select("q_id", "shown.*")


def area_alert_counts(new_jobs: DataFrame, areas: DataFrame) -> DataFrame:
    """(q_id, lead_id, n_new) per saved area: how many new postings it has, from counts per cell,
    and the smallest id among areas of equal box and conditions, whose postings are the same. As
    many rows as areas, whatever the postings; ``area_alerts`` of leading areas has the details."""
    counted = _box_counts(new_jobs, areas)
    leads = counted.groupBy("class").agg(F.min("q_id").alias("lead_id"))
    return counted.join(leads, "class").select("q_id", "lead_id", F.col("matching").alias("n_new"))
