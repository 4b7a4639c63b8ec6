"""Answers from counts per cell against brute force, and how their work grows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from postgeo.functions import geo
from postgeo.operators import batch, cluster, pyramid
from postgeo.session import cut_lineage

from .test_operators import CT, JOB, VP, great_circle, jobs, passes, viewports


def centers(n, seed=4):
    rng = random.Random(seed)
    out = []
    for q in range(n):
        lat, lng = (49.2827, -123.1207) if q % 7 == 0 else (49 + rng.random() * 0.5, -123.3 + rng.random() * 0.5)
        out.append((q, lat, lng, rng.choice([0.2, 3.0, 9.0, 50.0]), rng.choice([None, 18]), rng.choice([None, 25]), rng.choice([None, "", "retail"]), rng.choice([None, 1, 3, 500])))
    return out


def test_nearby_batch_equals_brute_force_also_at_a_hot_point(spark):
    rows, df = jobs(spark, 900, hot=500)
    cts = centers(150)
    got = {}
    for r in batch.nearby_batch(df, spark.createDataFrame(cts, CT)).collect():
        got.setdefault(r["q_id"], []).append((r["rn"], r["id"]))
    for q, lat, lng, radius, wmin, wmax, cat, lim in cts:
        near = sorted((great_circle(lat, lng, j[5], j[6]), j[0]) for j in rows if passes(j, wmin, wmax, cat))
        # within half a percent of the radius the shape of the earth decides
        sure = [i for m, i in near if m < radius * 995]
        doubt = {i for m, i in near if radius * 995 <= m <= radius * 1005}
        shown = [i for _, i in sorted(got.get(q, []))]
        assert [i for i in shown if i not in doubt] == sure[: lim or 100], q
        assert shown == [i for _, i in near if i in set(shown)] and len(shown) <= (lim or 100)


def test_meta_equals_brute_force(spark):
    rows, df = jobs(spark, 700, hot=300)
    vps = viewports(200)
    got = {r["q_id"]: r["matching"] for r in batch.viewport_meta(df, spark.createDataFrame(vps, VP)).collect()}
    for q, w, s, e, n, _, wmin, wmax, cat, _ in vps:
        assert got[q] == sum(w <= j[6] <= e and s <= j[5] <= n and passes(j, wmin, wmax, cat) for j in rows)


def test_alerts_of_equal_areas(spark):
    """Counts and pairs of saved areas against brute force; areas asked twice share a lead."""
    rows, df = jobs(spark, 500, hot=200)
    vps = viewports(60)
    vps += [(v[0] + 1000, *v[1:]) for v in vps[:40]]
    asked = spark.createDataFrame(vps, VP)
    want = {v[0]: {j[7] for j in rows if v[1] <= j[6] <= v[3] and v[2] <= j[5] <= v[4] and passes(j, *v[6:9])} for v in vps}
    counts = {r.q_id: r for r in batch.area_alert_counts(df, asked).collect()}
    assert {q: r.n_new for q, r in counts.items()} == {q: len(w) for q, w in want.items()}
    assert all(counts[v[0]].lead_id == counts[v[0] - 1000].lead_id <= v[0] - 1000 for v in vps[60:])
    pairs = batch.area_alerts(df, asked).select("q_id", "source_url").collect()
    assert len(pairs) == sum(map(len, want.values())) and all(r.source_url in want[r.q_id] for r in pairs)
    assert batch.area_alert_counts(df.limit(0), asked).agg(F.sum("n_new")).collect()[0][0] == 0


def test_boxes_along_cell_borders(spark):
    """Points and boxes exactly on the borders of cells, where rounding could decide."""
    rows = [(i * 40 + k, 1, "t", None, None, 49.0 + i * 0.01, -123.0 + k * 0.01, f"u{i}/{k}", 0.5, "retail", None, None) for i in range(40) for k in range(40)]
    df = spark.createDataFrame(rows, JOB)
    vps = [(q, -123.0 + a * 0.01, 49.0 + b * 0.01, -123.0 + c * 0.01, 49.0 + d * 0.01, 12, None, None, None, 500)
           for q, (a, b, c, d) in enumerate([(0, 0, 8, 8), (3, 5, 20, 9), (1, 1, 39, 39), (0, 7, 1, 8)])]
    want = {v[0]: sum(v[1] <= r[6] <= v[3] and v[2] <= r[5] <= v[4] for r in rows) for v in vps}
    asked = spark.createDataFrame(vps, VP)
    assert {r["q_id"]: r["matching"] for r in batch.viewport_meta(df, asked).collect()} == want
    shown = batch.viewport_batch(df, asked).groupBy("q_id").count().collect()
    assert {r["q_id"]: r["count"] for r in shown} == {q: min(n, 500) for q, n in want.items()}


def test_no_inner_cell_reaches_out_of_its_circle(spark):
    cts = [(q, lat, lng, r, None, None, None, 5) for q, (lat, lng, r) in enumerate([(49.2, -123.1, 9.0), (0.001, 179.99, 50.0), (-89.7, 10.0, 50.0), (66.0, -179.9, 30.0)])]
    classes, _ = pyramid.classes(batch.accepted(batch.check_centers(spark.createDataFrame(cts, CT))), batch.CIRCLE)
    cells = batch._center_cells(classes).where("inner")
    rng = random.Random(1)
    seen = 0
    for c in cells.select("lat", "lng", "radius_km", F.struct(*[x.alias(n) for x, n in zip(geo.cell_box(F.col("level"), F.col("cell")), "wsen")]).alias("b")).collect():
        for _ in range(5):
            lat, lng = rng.uniform(c.b.s, c.b.n), rng.uniform(c.b.w, c.b.e)
            assert great_circle(c.lat, c.lng, lat, lng) <= c.radius_km * 1000
            seen += 1
    assert seen > 100


def _town(spark, n, seed, requests):
    """Postings and requests of one area; a third of the postings on one point."""
    rng = random.Random(seed)
    rows = [
        (i, 1, "t", rng.choice([15, 20]), 30, *((49.28, -123.12) if i % 3 == 0 else (49.2 + rng.random() * 0.2, -123.2 + rng.random() * 0.2)),
         f"u{i}", 0.5, rng.choice(["retail", "other"]), None, dt.datetime(2024, 1, 1) - dt.timedelta(days=rng.randint(0, 400)))
        for i in range(n)
    ]
    boxes, circles = [], []
    for q in range(requests):
        w, s = -123.2 + rng.random() * 0.1, 49.2 + rng.random() * 0.1
        boxes.append((q, w, s, w + 0.1, s + 0.1, 12, rng.choice([None, 18]), None, rng.choice([None, "retail"]), 50))
        circles.append((q, s + 0.05, w + 0.05, 9.0, rng.choice([None, 18]), None, rng.choice([None, "retail"]), 50))
    return spark.createDataFrame(rows, JOB).repartition(4), spark.createDataFrame(boxes, VP), spark.createDataFrame(circles, CT)


def _work(spark, n, requests):
    df, boxes, circles = _town(spark, n, 7, requests)
    columns = batch._needed([], "posted_at")
    v, _ = pyramid.classes(batch.accepted(batch.check_viewports(boxes)), batch.BOX)
    c, _ = pyramid.classes(batch.accepted(batch.check_centers(circles)), batch.CIRCLE)
    slim = df.select(*columns).withColumn("bucket", batch._day(F.col("posted_at"), pyramid.id_range(df)))
    slim, v = pyramid.led_by_text(slim, v)
    counted = cut_lineage(batch.viewport_keys(slim, v)).count() + batch.viewport_candidates(slim, v, columns).count()
    near, c = pyramid.led_by_text(df.select(*columns), c)
    return counted, batch.nearby_candidates(near, c, columns).count()


def test_candidates_grow_less_than_the_pairs(spark):
    """Twice the requests on twice the postings of one area would be four times the pairs."""
    (box, circle), (box2, circle2) = _work(spark, 6000, 60), _work(spark, 12000, 120)
    assert box2 < 3.4 * box and circle2 < 3.4 * circle
    # far fewer candidates than postings in the areas
    assert circle2 < 120 * 12000 / 20


def test_equal_requests_are_one_class(spark):
    rows = [(q, -123.2, 49.1, -123.0, 49.3, 12, None, 25, cat, lim) for q, (cat, lim) in enumerate([(None, 5), ("", 40), ("retail", 5), (None, None)])]
    found, members = pyramid.classes(batch.accepted(batch.check_viewports(spark.createDataFrame(rows, VP))), batch.BOX)
    assert found.count() == 2 and members.count() == 4
    assert {(r["q_id"], r["lim"]) for r in members.collect()} == {(0, 5), (1, 40), (2, 5), (3, 100)}


def test_children_of_requested_clusters_equal_brute_force(spark):
    import math

    rows, df = jobs(spark, 600, hot=200)
    vps = [(q, w, s, e, n, zoom, *rest) for (q, w, s, e, n, _, *rest), zoom in zip(viewports(120), [0, 5, 9, 11, 12, 14, 17, 20] * 15)]

    def cluster_of(j, z):
        size = 70.3125 / 2**z
        return f"{z}/{math.floor((j[6] + 180) / size)}/{math.floor((j[5] + 90) / size)}"

    want, asked = set(), []
    for k, (q, w, s, e, n, z, wmin, wmax, cat, lim) in enumerate(vps):
        hit = [j for j in rows if w <= j[6] <= e and s <= j[5] <= n and passes(j, wmin, wmax, cat)]
        # one of its clusters, one cut by the edge of the box, or none that exists
        cid = cluster_of(hit[k % len(hit)], z) if hit and k % 5 else f"{z}/1/2" if k % 2 else None
        asked.append((q, w, s, e, n, z, wmin, wmax, cat, lim, cid))
        want |= {(q, cid, j[0]) for j in hit if cluster_of(j, z) == cid}
    got = cluster.children_of(df, spark.createDataFrame(asked, VP + ", cluster_id STRING"))
    got = [(r["q_id"], r["cluster_id"], r["child_id"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_category_sets_and_texts_equal_brute_force(spark):
    rng = random.Random(12)
    rows, df = jobs(spark, 500, hot=150)
    titles = {j[0]: rng.choice([None, "", "Cook wanted", "URGENT cook", "Driver, urgent", "x", "Ünïcode cook", "co"]) for j in rows}
    rows = [j[:2] + (titles[j[0]],) + j[3:] for j in rows]
    df = spark.createDataFrame(rows, JOB).repartition(3)
    sets = [None, [], ["retail"], ["other", "retail", None], ["nothing"]]
    texts = [None, "", "urgent", "COOK", "o", "co", "ünï", "no such words", "x"]
    vps = [v + (rng.choice(sets), rng.choice(texts)) for v in viewports(150)]
    asked = spark.createDataFrame(vps, VP + ", categories ARRAY<STRING>, text STRING")
    got = {}
    for r in batch.viewport_batch(df, asked, ["id"]).collect():
        got.setdefault(r["q_id"], []).append((r["rn"], r["id"]))
    metas = {r["q_id"]: r["matching"] for r in batch.viewport_meta(df, asked).collect()}
    for q, w, s, e, n, _, wmin, wmax, cat, lim, several, text in vps:
        several = [c for c in several or [] if c]
        hit = [j for j in rows if w <= j[6] <= e and s <= j[5] <= n and passes(j, wmin, wmax, cat) and (not several or j[9] in several) and (not text or text.lower() in (j[2] or "").lower())]
        hit.sort(key=lambda j: (j[11] is not None, -(j[11].timestamp() if j[11] else 0), j[0]))
        assert sorted(got.get(q, [])) == [(k + 1, j[0]) for k, j in enumerate(hit[: lim or 100])], (q, several, text)
        assert metas[q] == len(hit)


def _dense(spark, n=4000):
    """Distinct points in some 2 km, of many days."""
    rng = random.Random(5)
    rows = [(i, 1, rng.choice(["Cook wanted", "Urgent driver", None]), 15, 30, 49.2 + rng.random() * 0.02, -123.2 + rng.random() * 0.03, f"u{i}", 0.5, "retail", None,
             dt.datetime(2024, 1, 1) - dt.timedelta(hours=i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, JOB).repartition(4)


def test_few_points_of_a_dense_circle_are_tested(spark):
    """Crowded border cells are cut finer: pieces do not overlap, miss no point of the circle, and few points lie on the border."""
    rows, df = _dense(spark, 12000)
    lat, lng = 49.21, -123.185
    classes, _ = pyramid.classes(batch.accepted(batch.check_centers(spark.createDataFrame([(1, lat, lng, 1.0, None, None, None, 5)], CT))), batch.CIRCLE)
    slim, classes = pyramid.led_by_text(df, classes)
    pieces = pyramid.circle_pieces(batch.center_cells(classes).drop("dlat", "dlng"), pyramid.crowded(slim))
    at = df.select("id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.inline(geo.point_cells(F.col("lat"), F.col("lng"))))
    met = at.join(pieces, ["level", "cell"]).select("id", "inner").collect()
    inside = {r[0] for r in rows if great_circle(lat, lng, r[5], r[6]) <= 990}
    assert len({r.id for r in met}) == len(met) and inside <= {r.id for r in met}
    assert sum(not r.inner for r in met) < len(inside) / 2 < sum(r.inner for r in met)


def test_nearest_of_a_dense_place_come_from_few_points(spark, monkeypatch):
    rows, df = _dense(spark)
    seen, plain = [], batch._at_points

    def counted(*args):
        found = cut_lineage(plain(*args))
        seen.append(found.count())
        return found

    monkeypatch.setattr(batch, "_at_points", counted)
    got = batch.nearby_batch(df, spark.createDataFrame([(1, 49.21, -123.185, 1.0, None, None, None, 5)], CT), ["id"]).orderBy("rn").collect()
    assert [r["id"] for r in got] == [i for _, i in sorted((great_circle(49.21, -123.185, r[5], r[6]), r[0]) for r in rows)[:5]]
    assert seen[0] < 100


def test_boxes_that_the_newest_postings_fill_do_not_lay_out_the_others(spark, monkeypatch):
    rows, df = _dense(spark)
    seen, plain = [], batch.viewport_candidates
    monkeypatch.setattr(batch, "viewport_candidates", lambda jobs, classes, columns: (seen.append((jobs.count(), classes.count())), plain(jobs, classes, columns))[1])
    vps = [(1, -123.3, 49.1, -123.0, 49.3, 12, None, None, None, 5), (2, -123.3, 49.1, -123.0, 49.3, 12, None, None, "retail", 200)]
    got = batch.viewport_batch(df, spark.createDataFrame(vps, VP), ["id"]).collect()
    assert sorted((r["q_id"], r["rn"], r["id"]) for r in got) == [(1, i + 1, i) for i in range(5)] + [(2, i + 1, i) for i in range(200)]
    assert len(seen) == 2 and seen[0][0] < 200 and seen[1][0] < 1000 and seen[1][1] == 1
    seen.clear()
    vps.append((3, -123.3, 49.1, -123.0, 49.3, 12, 99, None, None, 5))  # nothing matches: only this one meets all postings
    assert batch.viewport_batch(df, spark.createDataFrame(vps, VP), ["id"]).count() == 205
    assert seen[-1] == (4000, 1)


def test_grams_looked_for_one_by_one_or_met(spark, monkeypatch):
    _, df = _dense(spark, 300)
    classes, _ = pyramid.classes(batch.accepted(batch.check_viewports(spark.createDataFrame(
        [(q, -123.3, 49.1, -123.0, 49.3, 12, None, None, None, 5, t) for q, t in enumerate(["urgent", "COOK", "o", "co", "none"])], VP + ", text STRING"))), batch.BOX)
    found = []
    for few in (32, 0):
        monkeypatch.setattr(pyramid, "FEW_GRAMS", few)
        slim, led = pyramid.led_by_text(df, classes)
        found.append((sorted(map(tuple, slim.select("id", "gram").collect())), sorted(map(tuple, led.select("text", "gram").collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 400


def test_grid_sums_do_not_grow_with_postings_kinds_and_zooms(spark, monkeypatch):
    """Clusters against brute force; what meets the classes is far less than the postings, though all have pay of their own."""
    rng = random.Random(9)
    rows, _ = _dense(spark, 6000)
    rows = [(*r[:3], rng.choice([None, 10 + r[0] % 3000]), rng.choice([None, 20 + r[0] % 2500]), *r[5:9], rng.choice(["retail", "other", None]), *r[10:]) for r in rows]
    df = spark.createDataFrame(rows, JOB).repartition(4)
    vps = [(q, -123.2, 49.2, -123.175, 49.215, 6 + q % 9, rng.choice([None, 700, 1500]), rng.choice([None, 900, 2000]), rng.choice([None, "", "retail"]), None) for q in range(36)]
    want = {}
    for q, w, s, e, n, z, wmin, wmax, cat, _ in vps:
        size = 70.3125 / 2**z
        for j in rows:
            if w <= j[6] <= e and s <= j[5] <= n and passes(j, wmin, wmax, cat):
                want.setdefault((q, f"{z}/{int((j[6] + 180) // size)}/{int((j[5] + 90) // size)}"), []).append(j)
    seen = []
    for name in ("met", "met_points"):
        plain = getattr(pyramid, name)
        monkeypatch.setattr(pyramid, name, lambda cells, counted, plain=plain: (seen.append(counted.count()), plain(cells, counted))[1])
    for few in (32, 1):  # limits told apart, and more of them than are
        monkeypatch.setattr(pyramid, "FEW_VALUES", few)
        got = {(r["q_id"], r["cluster_id"]): r for r in cluster.clusters_grid(df, spark.createDataFrame(vps, VP)).collect()}
        assert {k: r["count"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
        assert all(abs(r["center_lng"] - sum(j[6] for j in want[k]) / len(want[k])) < 1e-9 and r["min_lat"] == min(j[5] for j in want[k]) for k, r in got.items())
    # before, a point came once per kind
    assert sum(seen[:2]) < len(rows), seen


def test_postings_are_told_apart_by_what_is_asked(spark):
    rows, df = jobs(spark, 300)
    asked = spark.createDataFrame([(q, -180.0, -90.0, 180.0, 90.0, 5, wmin, wmax, cat, None) for q, (wmin, wmax, cat) in enumerate([(18, None, "retail"), (None, 25, None), (15, 30, "")])], VP)
    classes, _ = pyramid.classes(batch.accepted(batch.check_viewports(asked)), batch.BOX)
    got = {tuple(r) for r in pyramid.as_asked(df, classes).select("wage_min", "wage_max", "category").distinct().collect()}
    assert got <= {(a, b, c) for a in (None, 15, 18) for b in (None, 25, 30) for c in (None, "retail")} and len(got) > 4


def _tops(df):
    """Positions of the last step that makes rows of lists and of the last join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("inline("), plan.index("Join ")


def test_pairs_of_requests_and_postings_are_not_dealt_out(spark, monkeypatch):
    """Many equal areas on a hot point: they become rows in the tasks that met the postings, which are many."""
    monkeypatch.setattr(pyramid, "PAIRS_TOGETHER", 500)
    monkeypatch.setattr(pyramid, "TOGETHER", 8)
    rows, df = jobs(spark, 400, hot=300)
    hot = [(q, -123.13, 49.27, -123.11, 49.29, 12, None, None, "retail" if q % 2 else None, None) for q in range(90)]
    hot += [(None, *hot[0][1:]), (None, *hot[0][1:]), (3, *hot[3][1:])]  # ids may be null or come twice
    asked = spark.createDataFrame(hot, VP)

    def hits(v):
        return [j for j in rows if v[1] <= j[6] <= v[3] and v[2] <= j[5] <= v[4] and passes(j, *v[6:9])]

    found = batch.area_alerts(df, asked, [F.col("source_url"), F.round("lat", 1).alias("at")])
    by_list, by_join = _tops(found)
    assert by_list < by_join  # the pairs go nowhere after they were formed
    assert found.columns == ["q_id", "source_url", "at"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((v[0], j[7], round(j[5], 1)) for v in hot for j in hits(v)), key=key)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3

    opened = [(*v, f"12/{int((-123.1207 + 180) // (70.3125 / 4096))}/{int((49.2827 + 90) // (70.3125 / 4096))}") for v in hot]
    found = cluster.children_of(df, spark.createDataFrame(opened, VP + ", cluster_id STRING"))
    by_list, by_join = _tops(found)
    assert by_list < by_join
    size = 70.3125 / 4096
    want = [(o[0], o[-1], j[0]) for o in opened for j in hits(o) if f"12/{int((j[6] + 180) // size)}/{int((j[5] + 90) // size)}" == o[-1]]
    assert sorted(map(tuple, found.select("q_id", "cluster_id", "child_id").collect()), key=key) == sorted(want, key=key) and len(want) > 5000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
