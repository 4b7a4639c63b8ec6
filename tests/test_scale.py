"""Keys that hold a large share of the rows are spread over tasks."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from postgeo.functions import geo
from postgeo.operators import batch, cluster, geocode, pyramid
from postgeo.operators.batch import TESTED

from .test_operators import VP, jobs


@contextlib.contextmanager
def settings(spark, **values):
    before = {k.replace("_", "."): spark.conf.get(k.replace("_", ".")) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("_", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


GAZ = "name STRING, lat DOUBLE, lng DOUBLE, importance DOUBLE"


def test_rows_of_a_frequent_query_are_spread(spark):
    gaz = spark.createDataFrame([("12 main street", 49.1, -123.1, 0.9), ("7 oak street", 49.3, -123.3, None)], GAZ)
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 500 == 0, "7 Oak St").when(F.col("id") % 3 == 0, "Nowhere").otherwise("12 Main St").alias("location_text"),
        F.lit(None).cast("string").alias("region_hint"),
    )
    with settings(spark, spark_sql_adaptive_enabled="false", spark_sql_autoBroadcastJoinThreshold="-1"):
        got = geocode.geocode(rows, gaz).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in got.groupBy("task").agg(F.count("*").alias("count"), F.sum("confidence")).collect()]
        found = {r["location_text"]: (r["lat"], r["confidence"], r["n"]) for r in got.groupBy("location_text", "lat", "confidence").agg(F.count("*").alias("n")).collect()}
    assert sum(per_task) == 4000 and max(per_task) < 1200
    assert {k: (v[0], v[2]) for k, v in found.items()} == {"12 Main St": (49.1, 2661), "7 Oak St": (49.3, 8), "Nowhere": (None, 1331)}


def test_places_of_a_common_word_are_spread(spark):
    gaz = spark.range(600).select(F.concat(F.lit("main "), "id").alias("name"), F.lit(49.0).alias("lat"), F.lit(-123.0).alias("lng"), (F.col("id") / 600).alias("importance"))
    terms = spark.createDataFrame([(1, "Main"), (2, "main 59"), (3, "x")], "q_id LONG, term STRING")
    found = geocode.place_search(terms, gaz, 3)
    assert [r["name"] for r in found.where("q_id = 1").orderBy("rank").collect()] == ["main 599", "main 598", "main 597"]
    assert [r["name"] for r in found.where("q_id = 2").orderBy("rank").collect()] == ["main 599", "main 598", "main 597"]
    joins = [l for l in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in l and "node#" in l]
    assert joins and all("part#" in l for l in joins)


def test_grid_clusters_do_not_meet_every_posting_of_a_box(spark):
    """Equal and wide boxes: fewer rows leave the joins than there are pairs, and the counts are right."""
    df = jobs(spark, 4000, spread=1.0)[1].select("id", *TESTED)
    asked = [(q, -123.3 + 0.001 * (q % 5), 49.0, -122.3, 49.05 if q % 2 else 50.0, 6 + q % 7, None, None, "retail" if q % 3 == 0 else None, None) for q in range(40)]
    asked.append(asked[3])  # an id that is asked twice counts twice
    v = spark.createDataFrame(asked, VP)
    got = {r["cluster_id"]: r for r in cluster.clusters_grid(df, v).where("q_id = 3").collect()}
    want = {}
    for r in df.where("lng >= -123.297 and lng <= -122.3 and lat >= 49.0 and lat <= 49.05 and category = 'retail'").collect():
        size = 50 * 360 / 256 / 2**9
        want.setdefault(f"9/{int((r['lng'] + 180) // size)}/{int((r['lat'] + 90) // size)}", []).append(r)
    assert {k: r["count"] for k, r in got.items()} == {k: 2 * len(v) for k, v in want.items()}
    assert all(abs(got[k]["center_lat"] - sum(r["lat"] for r in v) / len(v)) < 1e-9 and got[k]["max_lng"] == max(r["lng"] for r in v) for k, v in want.items())
    # inner cells are answered by counts: the box of a whole degree keeps points on its border only
    box = spark.createDataFrame([(1, -123.3, 49.0, -122.3, 50.0)], "class LONG, min_lng DOUBLE, min_lat DOUBLE, max_lng DOUBLE, max_lat DOUBLE")
    pieces = pyramid.box_pieces(batch.viewport_cells(box), batch.BOX)
    at = df.select("id", "lat", "lng", F.inline(geo.point_cells(F.col("lat"), F.col("lng"))))
    met = at.join(pieces, ["level", "cell"])
    inside = df.where("lng >= -123.3 and lng <= -122.3 and lat >= 49.0 and lat <= 50.0").count()
    assert met.groupBy("id").count().where("count > 1").isEmpty()  # pieces do not overlap
    assert met.where("lng >= -123.3 and lng <= -122.3 and lat >= 49.0 and lat <= 50.0").count() == inside
    assert met.where("not inner").count() < inside / 4
