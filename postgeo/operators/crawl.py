"""Crawl bookkeeping: cursor, counts, retries, sessions, error rates.

``events`` holds one row per attempt: bbs, msgid, ok (0/1), ingested_at.
Every report here is one combinable aggregation, so a board with a third of all
attempts is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _ok():
    return F.col("ok") == 1


def advance_cursor(crawl_log: DataFrame, events: DataFrame) -> DataFrame:
    """Cursor per board: highest msgid stored so far; it never moves back."""
    stored = events.groupBy("bbs").agg(F.max(F.when(_ok(), F.col("msgid"))).alias("done"))
    known = crawl_log.groupBy("bbs").agg(F.max("last_seen_msgid").alias("known"))
    return known.join(stored, "bbs", "full_outer").select(
        "bbs", F.coalesce(F.greatest("known", "done"), F.lit(0)).alias("last_seen_msgid")
    )


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("bbs").agg(
        F.count_if(_ok()).alias("succeeded"), F.count_if(~_ok()).alias("failed")
    )


def error_rate(events: DataFrame) -> DataFrame:
    """Share of failed attempts per board and of all (``all_boards`` 1, bbs NULL)."""
    return events.rollup("bbs").agg(
        F.grouping("bbs").cast("int").alias("all_boards"),
        F.count(F.lit(1)).alias("attempts"), F.avg(F.when(_ok(), 0.0).otherwise(1.0)).alias("error_rate"),
    )


def retry_queue(events: DataFrame) -> DataFrame:
    """Posts whose last failure has no later success."""
    failed, done = F.when(~_ok(), F.col("ingested_at")), F.when(_ok(), F.col("ingested_at"))
    return (
        events.groupBy("bbs", "msgid")
        .agg(
            F.max(failed).alias("failed_at"), F.max(done).alias("done_at"),
            F.count_if(~_ok()).alias("failures"),
        )
        .where(F.col("failed_at").isNotNull() & (F.col("done_at").isNull() | (F.col("done_at") < F.col("failed_at"))))
        .select("bbs", "msgid", "failed_at", "failures")
    )


#: Numbers of a board are looked through in stretches of 2**STRETCH.
STRETCH = 16


def finished(events: DataFrame) -> DataFrame:
    """(bbs, first_msgid, last_msgid): the runs of consecutive numbers that were stored.

    Runs are found within stretches of numbers, then joined where one ends at its stretch's
    end, so no task sorts all numbers of a board.
    """
    done = events.where(_ok() & F.col("msgid").isNotNull()).select("bbs", "msgid", F.shiftright("msgid", STRETCH).alias("part")).distinct()

    def runs(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("first_msgid")
        new = F.coalesce((F.col("first_msgid") > F.lag("last_msgid").over(order) + 1).cast("int"), F.lit(1))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(upto)).groupBy(*keys, "_run").agg(
            F.min("first_msgid").alias("first_msgid"), F.max("last_msgid").alias("last_msgid")
        ).drop("_run")

    inner = runs(done.select("bbs", "part", F.col("msgid").alias("first_msgid"), F.col("msgid").alias("last_msgid")), ["bbs", "part"])
    edge = F.lit((1 << STRETCH) - 1)
    at_edge = (F.col("first_msgid").bitwiseAND(edge) == 0) | (F.col("last_msgid").bitwiseAND(edge) == edge)
    # only runs that touch the end of their stretch can go on in another one
    joined = runs(inner.where(at_edge).drop("part"), ["bbs"])
    return inner.where(~at_edge).select("bbs", "first_msgid", "last_msgid").unionByName(joined)


def sessions(events: DataFrame) -> DataFrame:
    """Per run: start, end, processed, failed."""
    return events.groupBy("run_id").agg(
        F.min("ingested_at").alias("started_at"), F.max("ingested_at").alias("ended_at"),
        F.count(F.lit(1)).alias("processed"), F.count_if(~_ok()).alias("failed"),
    )


def per_window(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Attempts and failures per board and tumbling window; also runs on a stream."""
    return events.groupBy(F.window("ingested_at", width).alias("w"), "bbs").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~_ok()).alias("failed")
    ).select("bbs", F.col("w.start").alias("window_start"), "attempts", "failed",
             (F.col("failed") / F.col("attempts")).alias("error_rate"))
