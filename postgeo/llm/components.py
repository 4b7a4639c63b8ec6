"""Connected components of a written list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postgeo.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b); root is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and then that
    label's own label, so a label's reach about doubles. Labels and links stay tables in
    the shared folder; only the count of changed nodes reaches the driver. No links: no rows.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut_lineage(
        both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        step = cut_lineage(
            labels.join(near, "node").select("node", "root", F.least("root", "low").alias("low")), "step"
        )
        far = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut_lineage(step.join(far, "low").select("node", "root", F.least("low", "lower").alias("new")), "labels")
        if new.where("new <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", F.col("new").alias("root"))
