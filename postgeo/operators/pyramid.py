"""Counts of postings per grid cell, and requests taken apart into cells.

A request covers few cells of one level. Those that lie wholly inside its area are answered
by counts alone; only the others meet postings. Counts are kept per cell for each set of
tested columns (a request that tests no pay needs no rows per pay), so the rows a request
adds up are bounded by the distinct values in its cells and do not grow with the postings.

Requests of equal area and conditions form one class and are answered once. A search text
is led by its rarest trigram: postings stand in an inverted index of the trigrams in use,
so a class meets only titles that hold it, and counts by title are exact like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..functions.fixed import EARTH_MEAN
from ..session import cut_lineage
from .pin import pin

TESTS = ["wage_min", "wage_max", "category"]
TESTED = ["lat", "lng", *TESTS]
#: What a class asks of a posting besides its place.
CONDITIONS = ["wage_min", "wage_max", "categories", "text"]
TEXT_KIND = 8
GRAM = 3
#: Cells count as inside only if they are so by more than rounding.
EDGE = 1e-9
#: Share of the radius up to which a distance on the sphere leaves no doubt about that on
#: the ellipsoid: the two differ by less than 0.6 %.
SURE = 0.99
#: Beyond this share of the radius a distance on the sphere leaves no doubt either.
DOUBT = 1.01
#: Ranges of ids within a point or a day without date.
ID_RANGES = 1024
#: Search trigrams that are looked for one by one in a title.
FEW_GRAMS = 32
#: Postings beyond which a cell on the border of an area is cut into finer ones.
CROWD = 100
#: Requests of a class in one list.
TOGETHER = 256
#: Pairs of a posting and a request of one cell that one task forms.
PAIRS_TOGETHER = 1 << 24
#: Values that requests test for, up to which postings are told apart by these alone.
FEW_VALUES = 32
#: Cells asked for that are broadcast to leave out postings of other cells early.
FEW_CELLS = 400_000


# --- requests ---------------------------------------------------------------------------


def with_kind(requests: DataFrame) -> DataFrame:
    """One list of ``categories`` ('' for any) from ``category`` and the optional ``categories``,
    the lower-cased ``text`` ('' for none), and ``kind``: one bit per column that is tested."""
    for name, kind in (("categories", "array<string>"), ("text", "string")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    one = F.coalesce("category", F.lit(""))
    several = F.array_sort(F.array_distinct(F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c.isNotNull())))
    r = requests.withColumns({
        "categories": F.when(F.size(several) == 0, F.array(one)).when(one == "", several).otherwise(F.filter(several, lambda c: c == one)),
        "text": F.lower(F.coalesce("text", F.lit(""))),
    }).drop("category")
    kind = (
        F.when(F.col("wage_min").isNotNull(), 1).otherwise(0)
        + F.when(F.col("wage_max").isNotNull(), 2).otherwise(0)
        + F.when(F.array_contains("categories", ""), 0).otherwise(4)
        + F.when(F.col("text") != "", TEXT_KIND).otherwise(0)
    )
    return r.withColumn("kind", kind)


def classes(asked: DataFrame, area: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members). Classes: ``class``, area, conditions, and the largest ``lim`` of
    their requests; members: q_id, lim and class of every request. Both written."""
    keys = [*area, *CONDITIONS, "kind"]
    asked = with_kind(asked)
    found = asked.groupBy(*keys).agg(F.max("lim").alias("lim")).withColumn("class", F.monotonically_increasing_id())
    found = cut_lineage(found, "classes")
    a, c = asked.alias("a"), found.alias("c")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}"))
    members = a.join(c, same).select("a.q_id", "a.lim", "c.class")
    return dealt(found), cut_lineage(members, "members")


def with_members(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Classes with ``asked_by``, the q_ids of their requests in lists of about TOGETHER, a row
    per list: what a class finds becomes rows of its requests without being dealt out again."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("class")) / TOGETHER)
    # by place in the table, as ids may repeat or be null; a list of the ids alone would lose nulls
    listed = members.select("class", "q_id", F.monotonically_increasing_id().alias("_at"))
    listed = listed.withColumn("part", F.pmod("_at", parts)).groupBy("class", "part").agg(F.collect_list(F.struct("q_id")).alias("asked_by"))
    return cut_lineage(classes.join(listed.drop("part"), "class"), "asked")


def met_evenly(placed: DataFrame, asked: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``placed`` joined to ``asked`` (see ``with_members``) on ``keys``. A key with many pairs is dealt
    to parts of about PAIRS_TOGETHER: its postings by ``spread`` to one part each, its requests to all.
    Both sides are written tables. Sizes in bytes do not show how many rows a task will make."""
    here = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = asked.groupBy(*keys).agg(F.sum(F.size("asked_by")).alias("m"))
    parts = here.join(there, keys).select(*keys, F.least(F.col("n"), F.ceil(F.col("n") * F.col("m") / PAIRS_TOGETHER)).cast("int").alias("parts"))
    parts = cut_lineage(parts.where("parts > 1"), "parts")
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")), F.lit(0)).cast("int")
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.join(parts, keys, "left").withColumn("_part", part).drop("parts").repartition(tasks, *keys, "_part")
    asked = asked.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return placed.join(asked, [*keys, "_part"]).drop("_part")


def dealt(classes: DataFrame) -> DataFrame:
    """Classes over all tasks: the few bytes of a class become many cells."""
    return classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class")


def _grams(text: Column, size: int) -> Column:
    """Distinct stretches of ``size`` code points."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def led_by_text(jobs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, classes) with ``gram``: of a class the rarest trigram of its text (a shorter text
    itself), '' without text; postings stand once under '' and once under each trigram of
    their title that leads a class."""
    if classes.where("text <> ''").isEmpty():
        return jobs.withColumn("gram", F.lit("")), classes.withColumn("gram", F.lit(""))
    size = F.least(F.char_length("text"), F.lit(GRAM))
    of_size = F.when(size == 1, _grams(F.col("text"), 1)).when(size == 2, _grams(F.col("text"), 2)).otherwise(_grams(F.col("text"), GRAM))
    asked = classes.where("text <> ''").select("class", F.explode(of_size).alias("gram"))
    asked = cut_lineage(asked, "grams")
    held = _holding(jobs, asked).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    order = F.struct(F.coalesce("held", F.lit(0)), "gram")
    leads = cut_lineage(asked.join(held, "gram", "left").groupBy("class").agg(F.min_by("gram", order).alias("gram")), "leads")
    postings = jobs.withColumn("gram", F.lit("")).unionByName(_holding(jobs, leads).select(*jobs.columns, "gram"))
    return postings, dealt(cut_lineage(classes.join(leads, "class", "left").withColumn("gram", F.coalesce("gram", F.lit(""))), "classes"))


def _holding(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings once per ``gram`` asked for that their title holds. A few grams are looked for
    one by one; many are met by the trigrams of the title."""
    grams = asked.select("gram").distinct()
    few = [r[0] for r in grams.limit(FEW_GRAMS + 1).collect()]
    titled, title = jobs.where(F.col("title").isNotNull()), F.lower("title")
    if len(few) <= FEW_GRAMS:
        held = F.array_compact(F.array(*[F.when(F.contains("_title", F.lit(g)), F.lit(g)) for g in few]))
        return pin(titled, _title=title).withColumn("gram", F.explode(held)).drop("_title")
    sizes = [r[0] for r in grams.select(F.char_length("gram")).distinct().collect()]
    return titled.withColumn("gram", F.explode(F.concat(*[_grams(title, k) for k in sizes]))).join(grams, "gram", "left_semi")


def inside_box(level: Column, cell: Column, w, s, e, n) -> Column:
    """Whether the cell lies wholly in the box."""
    cw, cs, ce, cn = geo.cell_box(level, cell)
    return (cw >= w + EDGE) & (cs >= s + EDGE) & (ce <= e - EDGE) & (cn <= n - EDGE)


#: How often the cells on the border of a box are cut into finer ones.
FINER = 2


def box_pieces(cells: DataFrame, box: list[str], crowd: DataFrame | None = None) -> DataFrame:
    """Cells of boxes with ``inner``; those on the border are cut into 4 x 4 finer ones, FINER
    times at most, and of these the ones outside are left out. No two cells of a class overlap.
    With ``crowd`` (see ``crowded``) border cells in it are cut on, down to the finest level."""
    edges = [F.col(c) for c in box]
    inner, touched = inside_box(F.col("level"), F.col("cell"), *edges), touches_box(F.col("level"), F.col("cell"), *edges)
    cells = cells.withColumn("inner", inner)
    others = [c for c in cells.columns if c not in ("level", "cell", "inner")]
    for _ in range(FINER):
        cut = ~F.col("inner") & (F.col("level") > geo.STREET)
        kept = F.array(F.struct(F.col("level").cast("int").alias("level"), F.col("cell").cast("bigint").alias("cell")))
        parts = F.when(cut, geo.cell_parts(F.col("level"), F.col("cell"))).otherwise(kept)
        cells = cells.select(*others, F.inline(parts)).where(touched).withColumn("inner", inner)
    done = None
    while crowd is not None:
        cells = cells.join(crowd.select("cell", F.lit(True).alias("many")), "cell", "left")
        cells = cut_lineage(cells.withColumn("many", ~F.col("inner") & F.coalesce("many", F.lit(False))), "cells")
        kept, cut = cells.where("not many").drop("many"), cells.where("many").drop("many")
        done = kept if done is None else done.unionByName(kept)
        if cut.isEmpty():
            return done
        cells = geo.with_parts(dealt(cut)).where(touched).withColumn("inner", inner)
    return cut_lineage(cells, "cells")


def touches_box(level: Column, cell: Column, w, s, e, n) -> Column:
    """Whether the cell can hold a point of the box."""
    cw, cs, ce, cn = geo.cell_box(level, cell)
    return (cw <= e + EDGE) & (cs <= n + EDGE) & (ce >= w - EDGE) & (cn >= s - EDGE)


def with_reach_km(cells: DataFrame) -> DataFrame:
    """Adds ``near_km`` and ``far_km``: at most and at least the distance on the sphere from the
    class's ``lat``, ``lng`` to any place in the cell. In short steps, as the JVM does not
    compile the code of one long formula."""
    columns = cells.columns
    row, col = geo.row_and_col(F.col("cell"))
    lat, lng, w, s, e, n = (F.col(c) for c in ("lat", "lng", "_w", "_s", "_e", "_n"))

    def around(edge: Column) -> Column:
        d = F.abs(edge - lng)
        return F.least(d, F.abs(360.0 - d))

    df = pin(cells, _size=geo.size_of(F.col("level")), _row=row, _col=col)
    df = pin(df, _w=F.col("_col") * F.col("_size") - 180.0, _s=F.col("_row") * F.col("_size") - 90.0)
    df = pin(df, _e=w + F.col("_size"), _n=s + F.col("_size"), _dw=around(w))
    df = pin(df, _de=around(e), _cos=F.cos(F.radians(lat)), _within=(lng >= w) & (lng <= e))
    df = pin(df, _high=F.greatest(F.abs(s - lat), F.abs(n - lat)) + EDGE, _low=F.greatest(F.lit(0.0), s - lat - EDGE, lat - n - EDGE))
    df = pin(df, _wide=F.greatest("_dw", "_de") + EDGE, _gap=F.when(F.col("_within"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least("_dw", "_de") - EDGE)))
    df = pin(df, _wide=F.when(F.col("_wide") + F.col("_size") > 180.0, F.lit(180.0)).otherwise(F.col("_wide")))
    # of its parallels the one nearest to the equator is the longest, the one farthest the shortest
    df = pin(df, _long=F.cos(F.radians(F.when((s <= 0) & (n >= 0), F.lit(0.0)).otherwise(F.least(F.abs(s), F.abs(n))))))
    df = pin(df, _short=F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(s), F.abs(n)) + EDGE))))

    def km(high: str, wide: str, along: str) -> Column:
        up, side = F.sin(F.radians(F.col(high)) / 2), F.sin(F.radians(F.col(wide)) / 2)
        return 2 * EARTH_MEAN / 1000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(up * up + F.col("_cos") * F.col(along) * side * side)))

    df = pin(df, far_km=km("_high", "_wide", "_long"))
    return pin(df, near_km=km("_low", "_gap", "_short")).select(*columns, "near_km", "far_km")


def crowded(jobs: DataFrame) -> DataFrame:
    """Cells of all levels but the finest with more than CROWD postings."""
    finest = jobs.where("gram = ''").groupBy(geo.cell_at(0, F.col("lat"), F.col("lng")).alias("_finest")).agg(F.count(F.lit(1)).alias("n"))
    levels = list(range(1, len(geo.LEVEL_SIZES)))
    on_all = finest.select("n", F.inline(geo.coarser_cells(F.col("_finest"), 0, levels)))
    return cut_lineage(on_all.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD).select("cell"), "crowded")


def circle_pieces(cells: DataFrame, crowd: DataFrame) -> DataFrame:
    """Cells of circles with ``inner``; crowded ones on the border are cut into 4 x 4 finer ones,
    and of these the ones outside are left out. No two cells of a class overlap."""
    columns = cells.columns

    def told(df: DataFrame) -> DataFrame:
        df = with_reach_km(df).where(F.col("near_km") <= F.col("radius_km") * DOUBT)
        df = df.select(*columns, (F.col("far_km") <= F.col("radius_km") * SURE).alias("inner"))
        df = df.join(crowd.select("cell", F.lit(True).alias("many")), "cell", "left")
        return cut_lineage(df.select(*columns, "inner", (~F.col("inner") & F.coalesce("many", F.lit(False))).alias("cut")), "cells")

    done, cells = None, told(cells)
    while True:
        kept = cells.where("not cut").drop("cut")
        done = kept if done is None else done.unionByName(kept)
        cut = cells.where("cut").drop("cut", "inner")
        if cut.isEmpty():
            return done
        cells = told(geo.with_parts(dealt(cut)))


# --- counts -----------------------------------------------------------------------------


def id_range(jobs: DataFrame, id_col: str = "id") -> Column:
    """Number of the id's range, of about ID_RANGES over the whole table; it grows with the id."""
    low, high = jobs.agg(F.min(id_col), F.max(id_col)).first()
    shift = 0
    while low is not None and (high >> shift) - (low >> shift) > ID_RANGES:
        shift += 1
    return F.shiftright(F.col(id_col), shift).cast("bigint")


def levels_of(cells: DataFrame) -> list[int]:
    """Levels in use, finest first; at most len(LEVEL_SIZES)."""
    return sorted(r[0] for r in cells.select("level").distinct().collect()) or [len(geo.LEVEL_SIZES) - 1]


def only_asked(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Leaves out rows whose (cell, gram) nobody asks for, where those asked for are few enough
    to be broadcast; else the join that follows does so."""
    asked = cells.select("cell", "gram").distinct()
    if asked.limit(FEW_CELLS + 1).count() > FEW_CELLS:
        return placed
    return placed.join(F.broadcast(asked), ["cell", "gram"], "left_semi")


def _titles(jobs: DataFrame) -> DataFrame:
    """Postings with a place, ``c_title`` where they stand under a gram."""
    title = F.when(F.col("gram") != "", F.lower("title")) if "title" in jobs.columns else F.lit(None).cast("string")
    return jobs.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("c_title", title)


def points(jobs: DataFrame, cells: DataFrame, extra: list[str]) -> DataFrame:
    """(cell, gram, p_lat, p_lng, c_wage_min, c_wage_max, c_category, c_title, *extra, n): postings
    that are alike, once in each of the ``cells`` they lie in."""
    alike = _titles(jobs).groupBy(*dict.fromkeys([*TESTED, *extra, "gram", "c_title"])).agg(F.count(F.lit(1)).alias("n"))
    names = {"lat": "p_lat", "lng": "p_lng", **{t: f"c_{t}" for t in TESTS}}
    placed = alike.select("*", F.inline(geo.point_cells(F.col("lat"), F.col("lng"), levels_of(cells)))).drop("level")
    return only_asked(placed, cells).withColumnsRenamed(names)


def met_points(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """Cells of classes with the points in them that meet their conditions."""
    any_of = F.array_contains("categories", "") | F.array_contains(F.col("categories"), F.col("c_category"))
    return cells.join(placed, ["cell", "gram"]).where(
        (F.col("wage_min").isNull() | (F.col("c_wage_min") >= F.col("wage_min")))
        & (F.col("wage_max").isNull() | (F.col("c_wage_max") <= F.col("wage_max")))
        & any_of & ((F.col("text") == "") | F.contains("c_title", "text"))
    ).drop("c_wage_min", "c_wage_max", "c_category", "c_title")


def of_kind(placed: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(rows, values): without the rows that fail any test of their ``kind``, and the values of
    the columns that it tests, ``c_...``."""
    tested = [F.col("kind").bitwiseAND(F.lit(b)) != 0 for b in (1, 2, 4)]
    for t, c in zip(tested, TESTS):
        placed = placed.where(~t | F.col(c).isNotNull())
    values = [F.when(t, F.col(c)).alias(f"c_{c}") for t, c in zip(tested[:2], TESTS)]
    return placed, [*values, F.when(tested[2], F.col("category")).otherwise(F.lit("")).alias("c_category")]


def as_asked(jobs: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings whose tested columns hold only what tells them apart for the classes: instead of
    the pay the highest lower (lowest upper) limit asked for that it meets, NULL if it meets
    none, and no category that nobody asks for. Every test has the same outcome. Columns with
    more than FEW_VALUES limits stay as they are."""
    def asked(values: DataFrame, order: str) -> list:
        found = values.toDF("v").where(F.col("v").isNotNull()).distinct()
        return [r[0] for r in found.orderBy(getattr(F, order)("v")).limit(FEW_VALUES + 1).collect()]

    def met(column: str, order: str, holds) -> Column:
        limits, kind = asked(classes.select(column), order), classes.schema[column].dataType
        if len(limits) > FEW_VALUES:
            return F.col(column)
        out = F.lit(None).cast(kind)
        for v in reversed(limits):
            out = F.when(holds(F.col(column), F.lit(v).cast(kind)), F.lit(v).cast(kind)).otherwise(out)
        return out

    names = asked(classes.select(F.explode("categories")), "asc")
    return jobs.withColumns({
        "wage_min": met("wage_min", "desc", lambda c, v: c >= v),
        "wage_max": met("wage_max", "asc", lambda c, v: c <= v),
        "category": F.col("category") if len(names) > FEW_VALUES else F.when(F.col("category").isin(names), F.col("category")),
    })


def counts(jobs: DataFrame, used: DataFrame, extra: list[str], cells: DataFrame | None = None) -> DataFrame:
    """(cell, kind, gram, c_wage_min, c_wage_max, c_category, c_title, *extra, n): postings per
    cell and the values of the columns that the kind tests; those that fail any such test
    are left out. ``jobs`` has ``gram`` (see ``led_by_text``).

    ``used`` holds the (level, kind) in use, at most 160 rows, so broadcasting it is safe.
    With ``cells`` only those need to be counted.
    """
    levels = levels_of(used)
    if "lat" in extra:
        alike, at = _titles(jobs), geo.point_cells(F.col("lat"), F.col("lng"), levels)
        keys = [*TESTED, *extra, "gram", "c_title"]
    else:  # postings of one cell of the finest level count together on all levels
        alike = _titles(jobs).withColumn("_finest", geo.cell_at(levels[0], F.col("lat"), F.col("lng")))
        at, keys = geo.coarser_cells(F.col("_finest"), levels[0], levels), ["_finest", *TESTS, *extra, "gram", "c_title"]
    alike = alike.groupBy(*dict.fromkeys(keys)).agg(F.count(F.lit(1)).alias("n"))
    placed = alike.select("*", F.inline(at))
    placed = (
        (placed if cells is None else only_asked(placed, cells))
        .join(F.broadcast(used), "level")
        .where((F.col("kind") >= TEXT_KIND) == (F.col("gram") != ""))
    )
    placed, values = of_kind(placed)
    keys = ["cell", "kind", "gram", "c_wage_min", "c_wage_max", "c_category", "c_title", *extra]
    return placed.select("cell", "kind", "gram", *values, "c_title", *extra, "n").groupBy(*keys).agg(F.sum("n").alias("n"))


def met(cells: DataFrame, counted: DataFrame) -> DataFrame:
    """Cells of classes with the counts that meet their conditions, per category asked for."""
    c = counted.withColumnRenamed("c_category", "category")
    asked = cells.select("*", F.explode("categories").alias("category"))
    return asked.join(c, ["cell", "kind", "category", "gram"]).where(
        (F.col("wage_min").isNull() | (F.col("c_wage_min") >= F.col("wage_min")))
        & (F.col("wage_max").isNull() | (F.col("c_wage_max") <= F.col("wage_max")))
        & ((F.col("text") == "") | F.contains("c_title", "text"))
    ).drop("c_wage_min", "c_wage_max", "c_title", "category")


def conditions_hold(titled: bool) -> Column:
    """Conditions of a class (columns ``q_...``) against a posting; ``titled``: it has a title."""
    out = (
        (F.col("q_wage_min").isNull() | (F.col("wage_min") >= F.col("q_wage_min")))
        & (F.col("q_wage_max").isNull() | (F.col("wage_max") <= F.col("q_wage_max")))
        & (F.array_contains("q_categories", "") | F.array_contains(F.col("q_categories"), F.col("category")))
    )
    return out & ((F.col("q_text") == "") | F.contains(F.lower("title"), F.col("q_text"))) if titled else out


def used_of(cells: DataFrame) -> DataFrame:
    return cells.select("level", "kind").distinct()
