"""The registered queries: library calls on the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgeo.functions import extract, fixed as X, labels, places
from postgeo.functions.text import strip_html
from postgeo.operators import batch, cluster, crawl, dedup, geocode, ingest, quality, regions, search, segment
from postgeo.plans import flow
from postgeo.sources.schemas import UPSERT_FIELDS
from postgeo.sources import mapcopy, snapshots
from postgeo.sources.tables import split_fetched

from postgeo.session import cut_lineage, scratch_path
from postgeo.streaming import jobs as streams

from .fixtures import view

NOW = "2001-06-15 12:00:00"
OLD_HOSTS, NEW_HOST = ["https://old.example", "https://www.old.example"], "https://bbs.example"
BOX = (-123.2, 49.15, -123.0, 49.35)
CENTER = (49.2827, -123.1207, 5.0)
EPS = 0.004


def r6(c) -> F.Column:
    return F.round(c, 6)


def ts(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 places, times as text, counts as BIGINT."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f.name)
        if t in ("double", "float"):
            c = r6(c)
        elif t.startswith("timestamp"):
            c = ts(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def base(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{table}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The given tables are single files of one split; rules over texts want all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def jobs(s, d):
    return view(s, d, "jobs_fx")


# --- scans, filters, single requests ---------------------------------------------


def q_regions_list(s, d):
    return regions.list_regions(view(s, d, "regions_fx"))


def q_viewport(s, d):
    f = search.Filters(wage_min=16, wage_max=30)
    return tidy(search.viewport(jobs(s, d), *BOX, f, limit=100, zoom=12))


def q_nearby(s, d):
    return tidy(search.nearby(jobs(s, d), *CENTER, search.Filters(category="retail"), limit=200))


def _map_copy(s, d):
    root = scratch_path(s, "map")
    mapcopy.publish(jobs(s, d), root, 2000)
    return root


def q_viewport_copy(s, d):
    """The request of ``viewport``, from the files of a map-ordered copy that it touches."""
    return tidy(mapcopy.viewport(s, _map_copy(s, d), BOX, search.Filters(wage_min=16, wage_max=30), 100))


def q_nearby_copy(s, d):
    return tidy(mapcopy.nearby(s, _map_copy(s, d), CENTER, search.Filters(category="retail"), 200))


def _filtered(s, d, f):
    return tidy(f.apply(jobs(s, d)).select("id", "title", "wage_min", "wage_max", "category"))


def q_filter_wage_min(s, d):
    return _filtered(s, d, search.Filters(wage_min=20))


def q_filter_wage_max(s, d):
    return _filtered(s, d, search.Filters(wage_max=20))


def q_filter_category(s, d):
    return _filtered(s, d, search.Filters(category="retail"))


def q_filter_category_set(s, d):
    return _filtered(s, d, search.Filters(categories=("retail", "cleaning")))


def q_filter_text(s, d):
    return _filtered(s, d, search.Filters(text="urgent"))


def q_validate_viewports(s, d):
    return batch.rejects(batch.check_viewports(view(s, d, "viewports_fx"), need_zoom=True))


def q_validate_centers(s, d):
    return batch.rejects(batch.check_centers(view(s, d, "centers_fx")))


def q_mappable(s, d):
    return tidy(search.mappable(jobs(s, d)).select("id", "lat", "lng"))


def q_wage_sort(s, d):
    return search.sort_by_wage(jobs(s, d).select("id", "wage_max"))


def q_review_queue(s, d):
    return tidy(quality.review_queue(jobs(s, d)))


def q_blocklist(s, d):
    return quality.remove_blocked(jobs(s, d), view(s, d, "blocklist_fx")).select("id", "source_url")


def q_favorites(s, d):
    return tidy(quality.favorites(jobs(s, d), view(s, d, "favorites_fx")).select("user_id", "id", "title", "posted_at"))


def q_apply_review(s, d):
    return tidy(quality.apply_review(jobs(s, d), view(s, d, "corrections_fx")).select("id", "lat", "lng", "reviewed"))


def q_review_history(s, d):
    return tidy(quality.review_history(jobs(s, d), view(s, d, "corrections_fx")))


def q_present(s, d):
    j = jobs(s, d).withColumn("distance_km", (F.col("id") % 977) / 7.0)
    return quality.present(j, F.lit(NOW).cast("timestamp"))


def q_freshness(s, d):
    return jobs(s, d).select("id", labels.age_label(F.col("posted_at"), F.lit(NOW).cast("timestamp")).alias("age_label"))


def q_category_counts(s, d):
    return quality.category_counts(jobs(s, d))


def q_confidence_kpi(s, d):
    return tidy(quality.confidence_kpi(jobs(s, d)))


# --- many requests ------------------------------------------------------------------


def q_viewport_batch(s, d):
    cols = ["id", "lat", "lng", "wage_min", "category", "posted_at"]
    return tidy(batch.viewport_batch(jobs(s, d), view(s, d, "viewports_fx"), cols))


def q_nearby_batch(s, d):
    return tidy(batch.nearby_batch(jobs(s, d), view(s, d, "centers_fx"), ["id", "lat", "lng", "category"]))


def searched(s, d, name):
    """Requests with category sets and search texts: some with one, some with both, most without."""
    v = view(s, d, name)
    sets = F.when(F.col("q_id") % 4 == 1, F.array(F.lit("retail"), F.lit("cleaning"))).when(F.col("q_id") % 4 == 2, F.array().cast("array<string>"))
    text = F.when(F.col("q_id") % 6 == 1, "Urgent").when(F.col("q_id") % 6 == 2, "5-L").when(F.col("q_id") % 6 == 3, "h")
    return v.withColumns({"categories": sets, "text": text})


def q_viewport_search(s, d):
    cols = ["id", "title", "category", "posted_at"]
    return tidy(batch.viewport_batch(jobs(s, d), searched(s, d, "viewports_fx"), cols))


def q_nearby_search(s, d):
    return tidy(batch.nearby_batch(jobs(s, d), searched(s, d, "centers_fx"), ["id", "title", "category"]))


def q_viewport_search_meta(s, d):
    return batch.viewport_meta(jobs(s, d), searched(s, d, "viewports_fx"))


def q_viewport_meta(s, d):
    return batch.viewport_meta(jobs(s, d), view(s, d, "viewports_fx"))


def q_nearby_meta(s, d):
    return tidy(batch.nearby_meta(jobs(s, d), view(s, d, "centers_fx")))


def q_viewport_page(s, d):
    return batch.viewport_page(jobs(s, d), view(s, d, "viewports_fx"), 20).select("q_id", "page", "rn", "id")


def _created(s, d):
    ok = ingest.storable(ingest.judge(view(s, d, "incoming_fx"), view(s, d, "gazetteer_fx")))
    return ingest.upsert(jobs(s, d), ok).where("created")


def q_area_alerts(s, d):
    # rounded once per posting, not once per pair
    shown = [F.col("source_url"), r6("lat").alias("lat"), r6("lng").alias("lng")]
    return batch.area_alerts(_created(s, d), view(s, d, "viewports_fx"), shown)


def q_area_alert_counts(s, d):
    """Counts of new postings and classes of equal areas."""
    return batch.area_alert_counts(_created(s, d), view(s, d, "viewports_fx"))


def q_clusters_grid(s, d):
    return tidy(cluster.clusters_grid(jobs(s, d), view(s, d, "viewports_fx")))


def q_clusters_meta(s, d):
    v = view(s, d, "viewports_fx")
    return cluster.clusters_meta(cluster.clusters_grid(jobs(s, d), v), v)


def q_cluster_children(s, d):
    return cluster.cluster_children(jobs(s, d), 11)


def q_cluster_children_batch(s, d):
    """Children of the largest cluster of every request."""
    j = jobs(s, d)
    asked = cut_lineage(cluster.largest_clusters(j, view(s, d, "viewports_fx")), "asked")
    return cluster.children_of(j, asked)


def q_cluster_sample(s, d):
    return tidy(cluster.cluster_sample(jobs(s, d), 12, 3).select("cluster_id", "rn", "id", "posted_at"))


def q_clusters_within(s, d):
    return tidy(cluster.clusters_within(jobs(s, d), EPS))


# --- places ---------------------------------------------------------------------------


def q_region_center(s, d):
    hints = view(s, d, "incoming_fx").groupBy("region_hint").agg(F.count(F.lit(1)).alias("n"))
    c = places.region_center(F.col("region_hint"))
    return tidy(hints.select("region_hint", "n", c["lat"].alias("lat"), c["lng"].alias("lng"), c["confidence"].alias("confidence")))


def q_geocode_query(s, d):
    q = places.place_query(F.col("location_text"), F.col("region_hint"))
    return view(s, d, "incoming_fx").select("location_text", "region_hint", q.alias("query")).distinct()


def q_norm_location(s, d):
    g = view(s, d, "gazetteer_fx").select("name", places.norm_location(F.col("name")).alias("key"))
    i = view(s, d, "incoming_fx").select(F.col("location_text").alias("name"), places.norm_location(F.col("location_text")).alias("key"))
    return g.unionByName(i).distinct()


def q_confidence(s, d):
    return tidy(view(s, d, "gazetteer_fx").select("name", "importance", places.confidence(F.col("importance")).alias("confidence")))


def q_geocode(s, d):
    g = geocode.geocode(view(s, d, "incoming_fx"), view(s, d, "gazetteer_fx"))
    return tidy(g.select("source_url", "seq", "location_text", "region_hint", "lat", "lng", "confidence"))


def q_place_search(s, d):
    return tidy(geocode.place_search(view(s, d, "terms_fx"), view(s, d, "gazetteer_fx"), 5))


# --- ingest -----------------------------------------------------------------------------


def _judged(s, d):
    return ingest.judge(view(s, d, "incoming_fx"), view(s, d, "gazetteer_fx"))


def q_ingest_rejects(s, d):
    bad = ingest.rejected(_judged(s, d)).select("source_url", "seq", "code", "details")
    _, lost = split_fetched(view(s, d, "raw_pages_fx"))
    unread = ingest.parse_rejects(segment.segment_posts(pages(s, d)))
    for more in (lost, unread):
        bad = bad.unionByName(more.select("source_url", F.lit(None).cast("bigint").alias("seq"), "code", "details"))
    return bad


def q_upsert_last_wins(s, d):
    return tidy(ingest.last_wins(ingest.storable(_judged(s, d))))


def q_upsert(s, d):
    up = ingest.upsert(jobs(s, d), ingest.storable(_judged(s, d)))
    return tidy(up.drop("id", "created_at"))


def q_crawl_log(s, d):
    return crawl.advance_cursor(view(s, d, "crawl_log_fx"), view(s, d, "crawl_events_fx"))


def q_crawl_counts(s, d):
    return crawl.counts(view(s, d, "crawl_events_fx"))


def q_retry_queue(s, d):
    return tidy(crawl.retry_queue(view(s, d, "crawl_events_fx")))


def q_crawl_error_rate(s, d):
    return tidy(crawl.error_rate(view(s, d, "crawl_events_fx")))


def q_crawl_finished(s, d):
    return crawl.finished(view(s, d, "crawl_events_fx"))


def q_crawl_sessions(s, d):
    return tidy(crawl.sessions(view(s, d, "crawl_events_fx")))


def q_regions_url(s, d):
    r = view(s, d, "regions_fx")
    return r.select("id", regions.rewrite_host(F.col("listing_url"), OLD_HOSTS[0], NEW_HOST).alias("listing_url"))


def q_regions_migrate(s, d):
    r = view(s, d, "regions_fx").withColumn("center", F.struct(F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")))
    m = regions.migrate(r, OLD_HOSTS, NEW_HOST)
    return tidy(m.select("id", "city", "bbs", "listing_url", F.col("center.lat").alias("center_lat"), F.col("center.lng").alias("center_lng")))


def q_post_url(s, d):
    p = segment.with_post_urls(view(s, d, "posts_fx").select("bbs", "msgid"), view(s, d, "regions_fx"), NEW_HOST)
    return p.select("bbs", "msgid", "listing_url", "url")


# --- text ---------------------------------------------------------------------------------


def posts(s, d):
    return dealt(view(s, d, "posts_fx"), "msgid")


def q_wage(s, d):
    p = posts(s, d).withColumn("n", extract.wage_numbers(F.col("body")))
    lo, hi = extract.wage_from_numbers(F.col("n"))
    return p.select("msgid", lo.alias("wage_min"), hi.alias("wage_max"))


def q_wage_anchored(s, d):
    lo, hi = extract.anchored_wage(F.col("body"))
    return posts(s, d).select("msgid", lo.alias("wage_min"), hi.alias("wage_max"))


def q_category(s, d):
    return posts(s, d).select("msgid", extract.category(F.col("title"), F.col("body")).alias("category"))


def q_city_hint(s, d):
    return posts(s, d).select("msgid", extract.city_hint(F.col("body")).alias("city"))


def q_posted_date(s, d):
    return tidy(posts(s, d).select("msgid", extract.posted_date(F.col("body")).alias("posted_at")))


def q_addresses(s, d):
    a = extract.with_addresses(posts(s, d), "body", "a")
    return a.select("msgid", F.posexplode("a").alias("pos", "address"))


def q_addresses_strict(s, d):
    a = extract.with_addresses(posts(s, d), "body", "a", "strict")
    return a.select("msgid", F.posexplode("a").alias("pos", "address"))


def q_multi_store(s, d):
    a = extract.with_addresses(posts(s, d), "body", "a")
    return a.select("msgid", F.size("a").cast("bigint").alias("n_addresses")).where("n_addresses > 1")


def q_store_name(s, d):
    return posts(s, d).select("msgid", extract.store_name(F.col("body"), F.col("title")).alias("store"))


def q_location_text(s, d):
    return ingest.extract_facts(posts(s, d)).select("msgid", "location_text")


def q_contact_keys(s, d):
    return dedup.contact_keys(posts(s, d))


def q_cross_board_dups(s, d):
    return dedup.cross_board_dups(posts(s, d))


def q_dup_ratio(s, d):
    return tidy(dedup.duplicate_share(posts(s, d)))


def pages(s, d):
    return dealt(view(s, d, "raw_pages_fx"), "url")


def q_strip_html(s, d):
    return pages(s, d).select("url", strip_html(F.col("html")).alias("text"))


def q_segment_posts(s, d):
    return segment.segment_posts(pages(s, d)).select("url", "msgid", "title", "body", "body_source")


def q_body_fallback(s, d):
    p = segment.segment_posts(pages(s, d))
    return p.groupBy("body_source").agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce(F.length("body"), F.lit(0))).alias("chars")
    )


def q_listing_msgids(s, d):
    x = view(s, d, "listings_fx").select("listing_id", segment.listing_msgids(F.col("html")).alias("ids"))
    return x.select("listing_id", F.posexplode("ids").alias("pos", "msgid"))


def q_new_msgids(s, d):
    return segment.new_msgids(view(s, d, "listings_fx"), view(s, d, "crawl_log_fx"))


def q_crawl_to_search(s, d):
    """Pages to postings to the nearest postings of every centre."""
    merged = flow.pages_to_snapshot(pages(s, d), jobs(s, d), view(s, d, "gazetteer_fx"), NEW_HOST)
    stored = cut_lineage(merged.drop("created"), "snapshot")
    found = batch.nearby_batch(stored, view(s, d, "centers_fx"), ["id", "source_url", "category", "confidence"])
    # ids of new rows are hashes; ties in distance are told apart by address
    return tidy(found.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance_km").alias("farthest_km")))


def q_page_records(s, d):
    return tidy(
        flow.page_records(pages(s, d), NEW_HOST).select(
            "source_url", "msgid", "title", "wage_min", "wage_max", "category", "region_hint", "location_text", "posted_at"
        )
    )


# --- streams: each run drains its input and returns what reached the sink -----------------


def q_stream_new_posts(s, d):
    """First sighting of every address in a feed of ingest calls."""
    feed = view(s, d, "incoming_fx").select(
        "source_url", "msgid", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("seen_at")
    )
    src = streams.as_feed(feed)
    out = streams.first_seen(streams.read_feed(s, src, feed.schema), "1 hour")
    return streams.run_to_table(out, "append").select("source_url", "msgid")


def q_stream_crawl_metrics(s, d):
    """Closed 15-minute windows of the crawl events."""
    events = view(s, d, "crawl_events_fx")
    src = streams.as_feed(events)
    out = streams.crawl_metrics(streams.read_feed(s, src, events.schema), "30 minutes")
    return tidy(streams.run_to_table(out, "append"))


def q_stream_alerts(s, d):
    """Saved areas hit by new postings as they arrive."""
    new = jobs(s, d).select("source_url", *batch.TESTED)
    src = streams.as_feed(new)
    areas = cut_lineage(batch.viewport_cells(batch.accepted(batch.check_viewports(view(s, d, "viewports_fx")))), "areas")
    out = streams.alerts(streams.read_feed(s, src, new.schema), areas)
    return tidy(streams.run_to_table(out, "append"))


def q_stream_ingest(s, d):
    """Pages arriving in files, merged batch by batch into the stored table."""
    p = view(s, d, "raw_pages_fx")
    src = streams.as_feed(dealt(p, "url"), 2)
    root = scratch_path(s, "snapshot")
    snapshots.publish(jobs(s, d), root, 8)
    streams.ingest_pages(
        streams.read_feed(s, src, p.schema, 1), root, view(s, d, "gazetteer_fx"), NEW_HOST, scratch_path(s, "state")
    )
    return tidy(snapshots.read_snapshot(s, root).select("source_url", *UPSERT_FIELDS))


def all_queries() -> dict:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_")}
