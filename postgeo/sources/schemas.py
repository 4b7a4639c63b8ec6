"""Table schemas. Points are two DOUBLE columns; text bodies are never stored."""

REGIONS = "id INT, city STRING, bbs INT, listing_url STRING, center STRUCT<lat: DOUBLE, lng: DOUBLE>"
JOBS = (
    "id BIGINT, msgid BIGINT, source_url STRING, region_hint STRING, title STRING, "
    "wage_min INT, wage_max INT, lat DOUBLE, lng DOUBLE, category STRING, confidence DOUBLE, "
    "posted_at TIMESTAMP, created_at TIMESTAMP"
)
CRAWL_LOG = "bbs INT, last_seen_msgid BIGINT, updated_at TIMESTAMP"
RAW_PAGES = "url STRING, bbs INT, html STRING, fetched_at TIMESTAMP"
INCOMING = (
    "source_url STRING, msgid BIGINT, region_hint STRING, title STRING, wage_min BIGINT, "
    "wage_max BIGINT, location_text STRING, category STRING, posted_at TIMESTAMP, seq BIGINT"
)
GAZETTEER = "name STRING, lat DOUBLE, lng DOUBLE, importance DOUBLE"

# columns an ingest call overwrites; id and created_at stay with the stored row
UPSERT_FIELDS = [
    "msgid", "title", "wage_min", "wage_max", "lat", "lng",
    "category", "confidence", "posted_at", "region_hint",
]
JOB_RESULT = [
    "id", "msgid", "title", "wage_min", "wage_max", "lat", "lng", "source_url",
    "confidence", "category", "region_hint", "posted_at",
]
