"""Single requests on a copy in map order."""

from __future__ import annotations

from postgeo.operators import search
from postgeo.sources import mapcopy

from .test_operators import jobs


def test_requests_read_few_files_and_find_the_same(spark, tmp_path):
    root = str(tmp_path / "a copy")
    _, df = jobs(spark, 3000, hot=1000)
    mapcopy.publish(df.unionByName(df.limit(5).selectExpr("* except (lat)", "cast(null as double) as lat").select(df.columns)), root, 100)
    total = len(spark.read.parquet(f"{root}/rows").inputFiles())
    assert total >= 25
    sizes = [r["n"] for r in spark.read.parquet(f"{root}/zones").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400  # also where a third of the rows has one point
    box, center = (-123.05, 49.05, -122.95, 49.12), (49.4, -122.9, 4.0)
    for rows in (mapcopy.rows_in_box(spark, root, *box), mapcopy.rows_around(spark, root, *center)):
        assert 0 < len(rows.inputFiles()) <= total / 3
    keep = search.Filters(category="retail")
    assert [r["id"] for r in mapcopy.viewport(spark, root, box, keep, 50).collect()] == [r["id"] for r in search.viewport(df, *box, keep, 50).collect()]
    assert [r["id"] for r in mapcopy.nearby(spark, root, center, keep, 50).collect()] == [r["id"] for r in search.nearby(df, *center, keep, 50).collect()]
    assert mapcopy.viewport(spark, root, (10.0, 10.0, 11.0, 11.0)).collect() == []


def test_a_request_for_very_many_files_reads_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mapcopy, "NAMED", 3)
    root = str(tmp_path / "copy")
    _, df = jobs(spark, 500)
    mapcopy.publish(df, root, 50)
    box = (-124.0, 49.0, -122.0, 50.0)
    assert mapcopy.viewport(spark, root, box, limit=500).count() == search.viewport(df, *box, limit=500).count() == 500
