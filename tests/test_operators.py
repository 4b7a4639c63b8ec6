"""Joins, merges and clusters against brute force on small tables."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from postgeo.functions import geo, places
from postgeo.operators import batch, cluster, geocode, ingest, quality, search
from postgeo.sources.tables import write_snapshot

JOB = "id BIGINT, msgid BIGINT, title STRING, wage_min INT, wage_max INT, lat DOUBLE, lng DOUBLE, source_url STRING, confidence DOUBLE, category STRING, region_hint STRING, posted_at TIMESTAMP"


def jobs(spark, n=300, seed=1, hot=0, spread=0.5, lng0=-123.3, lat0=49.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = (49.2827, -123.1207) if i < hot else (lat0 + rng.random() * spread, lng0 + rng.random() * spread)
        lng = at[1] if at[1] <= 180 else at[1] - 360
        posted = None if i % 9 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 500))
        rows.append((i, i, f"t{i}", rng.choice([None, 15, 20]), rng.choice([None, 22, 30]), at[0], lng, f"u{i}", 0.5, rng.choice(["retail", "other"]), None, posted))
    return rows, spark.createDataFrame(rows, JOB).repartition(4)


def viewports(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for q in range(n):
        w, s = -123.3 + rng.random() * 0.4, 49 + rng.random() * 0.4
        size = rng.choice([0.003, 0.05, 0.4, 40.0])
        out.append((q, w, s, w + size, s + size / 2, 12, rng.choice([None, 18]), rng.choice([None, 25]), rng.choice([None, "", "retail"]), rng.choice([None, 3, 500])))
    return out


VP = "q_id BIGINT, min_lng DOUBLE, min_lat DOUBLE, max_lng DOUBLE, max_lat DOUBLE, zoom INT, wage_min INT, wage_max INT, category STRING, lim INT"
CT = "q_id BIGINT, lat DOUBLE, lng DOUBLE, radius_km DOUBLE, wage_min INT, wage_max INT, category STRING, lim INT"


def passes(j, wmin, wmax, cat):
    return (
        (wmin is None or (j[3] is not None and j[3] >= wmin))
        and (wmax is None or (j[4] is not None and j[4] <= wmax))
        and (not cat or j[9] == cat)
    )


def test_viewport_batch_equals_brute_force(spark):
    rows, df = jobs(spark, 900, hot=600)
    vps = viewports()
    got = {}
    for r in batch.viewport_batch(df, spark.createDataFrame(vps, VP)).collect():
        got.setdefault(r["q_id"], []).append((r["rn"], r["id"]))
    for q, w, s, e, n, _, wmin, wmax, cat, lim in vps:
        hit = [j for j in rows if w <= j[6] <= e and s <= j[5] <= n and passes(j, wmin, wmax, cat)]
        hit.sort(key=lambda j: (j[11] is not None, -(j[11].timestamp() if j[11] else 0), j[0]))
        want = [(k + 1, j[0]) for k, j in enumerate(hit[: lim or 100])]
        assert sorted(got.get(q, [])) == want, q


def test_single_viewport_is_one_row_of_the_batch(spark):
    _, df = jobs(spark)
    one = [(1, -123.2, 49.1, -123.0, 49.4, 12, 18, None, "retail", 50)]
    a = [r["id"] for r in search.viewport(df, -123.2, 49.1, -123.0, 49.4, search.Filters(wage_min=18, category="retail"), 50).collect()]
    b = [r["id"] for r in batch.viewport_batch(df, spark.createDataFrame(one, VP)).orderBy("rn").collect()]
    assert a == b and a


def great_circle(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371008.7714 * math.asin(math.sqrt(h))


def test_nearby_across_the_date_line_and_at_the_pole(spark):
    rows, df = jobs(spark, 400, seed=5, spread=1.2, lng0=179.4, lat0=-17.0)
    polar = [(1000 + i, i, "p", None, None, 89.95, lng, f"p{i}", 0.5, "other", None, None) for i, lng in enumerate(map(float, range(-180, 180, 30)))]
    df = df.unionByName(spark.createDataFrame(polar, JOB))
    rows = rows + polar
    cts = [(q, -16.5, lng, 40.0, None, None, None, 500) for q, lng in enumerate([179.9, -179.95, 180.0, -180.0])]
    cts.append((9, 89.9, 10.0, 50.0, None, None, None, 500))
    got = {}
    for r in batch.nearby_batch(df, spark.createDataFrame(cts, CT)).collect():
        got.setdefault(r["q_id"], {})[r["id"]] = r["distance_km"]
    for q, lat, lng, radius, *_ in cts:
        dist = {j[0]: great_circle(lat, lng, j[5], j[6]) for j in rows}
        sure_in = {i for i, m in dist.items() if m < radius * 1000 * 0.99}
        maybe_in = {i for i, m in dist.items() if m < radius * 1000 * 1.01}
        assert sure_in <= set(got[q]) <= maybe_in and sure_in
        assert all(abs(got[q][i] - dist[i] / 1000) < 1e-6 for i in got[q])


def test_ellipsoid_distance(spark):
    df = spark.createDataFrame([(49.0, -123.0, 49.0, -123.0), (0.0, 0.0, 0.0, 1.0), (49.0, -123.0, 50.0, -123.0)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = [r["m"] for r in geo.with_ellipsoid_m(df, "m", *(F.col(x) for x in "abcd")).collect()]
    # one degree along the equator, and along the meridian from 49 to 50 north
    assert got[0] == 0.0 and abs(got[1] - 111319.49) < 0.1 and abs(got[2] - 111219.6) < 5


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_plan_has_no_nested_loop(spark):
    _, df = jobs(spark, 500)
    plan = final_plan(batch.viewport_batch(df, spark.createDataFrame(viewports(50), VP)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "WindowGroupLimit" in plan


def test_hot_cell_is_split_by_adaptive_execution(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rng = random.Random(3)
        cold = spark.range(4000).select((F.rand(1) * 40 + 10).alias("lat"), (F.rand(2) * 60 - 120).alias("lng"))
        hot = spark.range(20000).select((F.rand(3) * 0.001 + 49.2821).alias("lat"), (F.rand(4) * 0.001 - 123.1209).alias("lng"))
        df = cold.unionByName(hot).select(
            F.monotonically_increasing_id().alias("id"), "lat", "lng", F.lit(20).alias("wage_min"), F.lit(30).alias("wage_max"),
            F.lit("retail").alias("category"), F.lit(None).cast("timestamp").alias("posted_at"),
        ).repartition(16)
        vps = [(q, -123.125 + rng.random() * 0.001, 49.28, -123.118, 49.285, 12, None, None, None, 10) for q in range(5)]
        out = batch.match_viewports(df, spark.createDataFrame(vps, VP), ["id", *batch.TESTED])
        assert "skew=true" in final_plan(out.groupBy("q_id").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old["spark.sql.autoBroadcastJoinThreshold"])
        for k in ("autoBroadcastJoinThreshold", "skewJoin.skewedPartitionThresholdInBytes", "skewJoin.skewedPartitionFactor", "advisoryPartitionSizeInBytes", "coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.adaptive.{k}")


def naive_clusters(points, eps):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a, b) in enumerate(points):
        for k in range(i):
            if (a - points[k][1]) ** 2 + (b - points[k][2]) ** 2 <= eps * eps:
                parent[find(i)] = find(k)
    groups = {}
    for i, p in enumerate(points):
        groups.setdefault(find(i), []).append(p[0])
    return sorted((min(g), len(g)) for g in groups.values())


def test_clusters_equal_union_find(spark):
    rng = random.Random(11)
    eps = 0.02
    pts = [(i, 49 + rng.random() * 0.4, -123 + rng.random() * 0.4) for i in range(500)]
    # a dense spot, a long chain, and two dense strips exactly around eps apart
    pts += [(500 + i, 49.2 + rng.random() * 1e-3, -123.5 + rng.random() * 1e-3) for i in range(200)]
    pts += [(700 + i, 50.0, -124 + i * 0.019) for i in range(60)]
    pts += [(800 + i, 51.0 + i * 1e-4, -120.0 - rng.random() * 1e-5) for i in range(80)]
    pts += [(900 + i, 51.0 + i * 1e-4, -120.0 + eps + rng.random() * 1e-5) for i in range(80)]
    df = spark.createDataFrame(pts, "id BIGINT, lat DOUBLE, lng DOUBLE").repartition(4)
    got = sorted((r["cluster_id"], r["count"]) for r in cluster.clusters_within(df, eps).collect())
    assert got == naive_clusters(pts, eps)


INC = "source_url STRING, msgid BIGINT, region_hint STRING, title STRING, wage_min BIGINT, wage_max BIGINT, location_text STRING, category STRING, posted_at TIMESTAMP, seq BIGINT"
GAZ = "name STRING, lat DOUBLE, lng DOUBLE, importance DOUBLE"
STORED = JOB + ", created_at TIMESTAMP"


def batch_of(spark):
    inc = spark.createDataFrame(
        [
            ("u1", 1, "Banff", "old", 10, 12, "1 Main St", "retail", None, 1),
            ("u1", 1, "Banff", None, None, None, "1 Main St", None, None, 2),
            ("u2", 2, None, "x", 5, 5, "unknown place", "other", None, 3),
            ("u3", 3, "Toronto", "x", 5, 6045551234, "1 Main St", "other", None, 4),
            ("u4", 4, "Toronto", "x", 5, 6, " ", "other", None, 5),
            ("u4", 4, None, "late failure", 7, 7, "nowhere", "other", None, 6),
        ],
        INC,
    )
    gaz = spark.createDataFrame([("1 main street", 50.0, -120.0, 0.4), ("1 Main St.", 51.0, -121.0, 0.71)], GAZ)
    return ingest.judge(inc, gaz)


def test_upsert(spark):
    judged = batch_of(spark)
    assert {(r["source_url"], r["code"]) for r in ingest.rejected(judged).collect()} == {
        ("u2", "GEOCODING_FAILED"), ("u3", "INTERNAL_ERROR"), ("u4", "GEOCODING_FAILED")
    }
    when = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame(
        [(77, 1, "title", 9, 9, 1.0, 2.0, "u1", 0.9, "retail", "x", when, when), (78, 8, "keep", 9, 9, 1.0, 2.0, "u8", 0.9, "retail", "x", when, when)], STORED
    )
    once = ingest.upsert(stored, ingest.storable(judged), F.lit("2024-02-02").cast("timestamp"))
    rows = {r["source_url"]: r for r in once.collect()}
    assert sorted(rows) == ["u1", "u4", "u8"]
    u1 = rows["u1"]
    # overwritten with NULL, id and created_at kept
    assert (u1["id"], u1["title"], u1["wage_min"], u1["category"], u1["created_at"]) == (77, None, None, None, when)
    assert (u1["lat"], u1["confidence"], u1["created"]) == (51.0, 0.9, False)
    assert rows["u4"]["created"] is True and rows["u4"]["confidence"] == 0.5 and rows["u4"]["wage_max"] == 6
    assert rows["u8"]["title"] == "keep" and rows["u8"]["created"] is None
    twice = ingest.upsert(once.drop("created"), ingest.storable(judged), F.lit("2025-02-02").cast("timestamp")).drop("created")
    assert sorted(map(tuple, twice.select(sorted(twice.columns)).collect()), key=str) == sorted(
        map(tuple, once.select(sorted(twice.columns)).collect()), key=str
    )
    assert ingest.duplicate_ids(once).count() == 0


def test_merge_reads_a_snapshot_without_shuffling_it(spark, tmp_path):
    _, df = jobs(spark, 200)
    write_snapshot(df.withColumn("created_at", F.current_timestamp()), "snap_jobs", str(tmp_path / "snap"), 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = ingest.upsert(spark.table("snap_jobs"), ingest.storable(batch_of(spark)))._jdf.queryExecution().executedPlan().toString()
        scan_side = plan[: plan.index("snap_jobs")]
        assert "Exchange" not in scan_side[scan_side.rindex("SortMergeJoin"):]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE snap_jobs")


def test_place_search(spark):
    gaz = spark.createDataFrame([("12 Main Street", 1.0, 2.0, 0.2), ("Main Square", 1.0, 2.0, 0.9), ("Domain", 1.0, 2.0, 1.0)], GAZ)
    terms = spark.createDataFrame([(1, "main "), (2, "MAIN s"), (3, "12 ma"), (4, "zzz"), (5, "")], "q_id BIGINT, term STRING")
    got = sorted((r["q_id"], r["rank"], r["name"]) for r in geocode.place_search(terms, gaz, 5).collect())
    assert got == [(1, 1, "Main Square"), (1, 2, "12 Main Street"), (2, 1, "Main Square"), (2, 2, "12 Main Street"), (3, 1, "12 Main Street")]


def test_place_search_of_terms_of_any_length_and_of_very_long_names(spark):
    rng = random.Random(6)
    words = ["main", "market", "mar", "square", "king", "kingsway", "st", "old", "north"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)] + [" ".join(f"w{i}" for i in range(5000))]
    gaz = [(n, 1.0, 2.0, round(rng.random(), 3)) for n in names]
    asked = []
    for i in range(200):
        name = rng.choice(names[:-1])
        at = rng.choice([0, *(k + 1 for k, c in enumerate(name) if c == " ")])
        asked.append((i, name[at : at + rng.randint(1, 70)]))
    asked += [(900, "w17 w18"), (901, "w4999"), (902, "nothing at all of this kind, whatever its length is, and it is long")]
    got = {}
    df = geocode.place_search(spark.createDataFrame(asked, "q_id BIGINT, term STRING"), spark.createDataFrame(gaz, GAZ).repartition(3), 5)
    for r in df.collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["name"]))
    spelled = {r["name"]: r["key"] for r in spark.createDataFrame(gaz, GAZ).select("name", places.norm_location(F.col("name")).alias("key")).collect()}
    terms = {r["q_id"]: r["t"] for r in spark.createDataFrame(asked, "q_id BIGINT, term STRING").select("q_id", places.norm_prefix(F.col("term")).alias("t")).collect()}
    for q, _ in asked:
        hit = sorted({(-imp, n) for n, _, _, imp in gaz if (" " + spelled[n]).find(" " + terms[q]) >= 0})
        assert [n for _, n in sorted(got.get(q, []))] == [n for _, n in hit[:5]], terms[q]


def test_blocked_hosts_that_occur_and_odd_addresses(spark):
    rows = [(i, f"https://bad.example/p{i}") for i in range(300)] + [(400, "https://good.example/x"), (401, "https://[bad"), (402, None), (403, "https://good.example/y")]
    df = spark.createDataFrame(rows, "id LONG, source_url STRING")
    block = spark.createDataFrame([(None, "bad.example"), ("https://good.example/y", None), (None, None)], "source_url STRING, host STRING")
    got = quality.remove_blocked(df, block)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == [400, 401, 402]


def test_take_in_returns_what_it_refuses(spark):
    from postgeo.plans import flow
    from postgeo.sources import schemas

    pages = spark.createDataFrame(
        [("http://x/listing.php?bbs=4", 4, "<body><div>No.7</div><h2>Cook</h2><p>We need a cook in Vancouver, evenings and weekends, good pay</p></body>"),
         ("http://x/none", 4, "<body>nothing that looks like a post of a board, only some words</body>"), ("http://x/gone", 4, None)],
        "url STRING, bbs INT, html STRING",
    ).withColumn("fetched_at", F.current_timestamp())
    stored = spark.createDataFrame([], schemas.JOBS)
    places = spark.createDataFrame([("Vancouver, BC, Canada", 49.0, -123.0, 0.8)], "name STRING, lat DOUBLE, lng DOUBLE, importance DOUBLE")
    merged, refused = flow.take_in(pages, stored, places, "http://x")
    codes = {r["source_url"]: r["code"] for r in refused.collect()}
    assert codes["http://x/none"] == "PARSE_FAILED" and codes["http://x/gone"] == "FETCH_FAILED"
    assert merged.count() + sum(c not in ("PARSE_FAILED", "FETCH_FAILED") for c in codes.values()) == 1


def _board_page(n, city):
    return (f"http://x/listing.php?bbs=4&p={n}", 4, f"<body><div>No.{n}</div><h2>Cook {n}</h2><p>We need a cook in {city}, evenings and weekends, $2{n % 10}/hr</p></body>", f"2024-01-0{1 + n % 9} 00:00:00")


def test_stream_stops_and_goes_on_in_a_new_session(spark, tmp_path):
    from postgeo.sources import schemas, snapshots
    from postgeo.streaming import jobs as streams

    schema = "url STRING, bbs INT, html STRING, fetched_at STRING"
    places = spark.createDataFrame([("Vancouver, BC, Canada", 49.0, -123.0, 0.8)], "name STRING, lat DOUBLE, lng DOUBLE, importance DOUBLE")
    batches = [[_board_page(n, "Vancouver") for n in range(1, 6)], [_board_page(n, "Victoria") for n in range(4, 9)] + [("http://x/gone", 4, None, "2024-01-09 00:00:00")]]
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    tables = []
    for way in ("stopped", "through"):
        root, feed, state = (str(tmp_path / f"{way}-{x}") for x in ("root", "feed", "state"))
        snapshots.publish(spark.createDataFrame([], schemas.JOBS), root, 16)
        session = spark
        for rows in batches:
            df = spark.createDataFrame(rows, schema).coalesce(1)
            df.write.mode("append").parquet(feed)
            if way == "stopped":  # drained, and started again for the next file
                session = spark.newSession()
                session.conf.set("spark.sql.session.timeZone", "UTC")
                streams.ingest_pages(streams.read_feed(session, feed, df.schema, 1), root, session.createDataFrame(places.toPandas()), "http://x", state, now)
        if way == "through":
            streams.ingest_pages(streams.read_feed(session, feed, df.schema, 1), root, places, "http://x", state, now)
        got = snapshots.read_snapshot(spark, root)
        tables.append(sorted(map(str, got.select("source_url", "title", "region_hint", "wage_min").collect())))
        assert got.count() == 8 and ingest.duplicate_ids(got).isEmpty()
        assert [tuple(r)[:2] for r in streams.cursors(spark, root).collect()] == [(4, 8)]
        assert "FETCH_FAILED" in {r["code"] for r in snapshots.read_side(spark, root, "refused").collect()}
    assert tables[0] == tables[1]


def test_a_batch_writes_only_its_bucket_and_counts_once(spark, tmp_path):
    import os

    from postgeo.sources import schemas, snapshots

    root = str(tmp_path / "snap")
    rows, df = jobs(spark, 200, seed=3)
    stored = df.withColumn("source_url", F.concat(F.lit("u"), F.col("id"))) if "source_url" not in df.columns else df
    full = spark.createDataFrame([], schemas.JOBS).unionByName(stored, allowMissingColumns=True)
    snapshots.publish(full, root, 8)
    one = full.limit(1).withColumn("title", F.lit("changed")).withColumn("seq", F.lit(1).cast("long"))
    for _ in range(2):
        snapshots.merge_batch(spark, root, one, 0)
    assert len([d for d in os.listdir(f"{root}/data/epoch=0") if d.startswith("bucket=")]) == 1
    got = snapshots.read_snapshot(spark, root)
    assert got.count() == 200 and got.where("title = 'changed'").count() == 1
