"""Oracle SQL for DuckDB, written against the same derived tables.

It follows the rules of the data, not the plans of the library: plain range joins,
RE2 patterns without look-around, list functions.
"""

from __future__ import annotations

from postgeo.functions import fixed as X

from .fixtures import for_duckdb
from .queries import BOX, CENTER, NEW_HOST, NOW, OLD_HOSTS

W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
D = r"\p{Nd}"


def rx(p: str) -> str:
    return p.replace("<W>", W).replace("<D>", D).replace("'", "''")


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{W}]+|[{W}]+\\z', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{W}]+', ' ', 'g'), ' ')"


def find_all(c: str, p: str, g: int = 1) -> str:
    return f"regexp_extract_all({c}, '{rx(p)}', {g})"


def find(c: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{rx(p)}', {g}), '')"


def any_in(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.lower()}')" for w in words) + ")"


def distinct_ci(c: str) -> str:
    return (
        f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i)"
    )


O: dict[str, str] = {}
COLS = (
    "id, msgid, title, wage_min, wage_max, round(lat,6) AS lat, round(lng,6) AS lng, source_url, "
    "round(confidence,6) AS confidence, category, region_hint, "
    f"{ts('posted_at')} AS posted_at"
)

# --- single requests ---------------------------------------------------------------
O["regions_list"] = "SELECT id, city, bbs, listing_url FROM regions_fx ORDER BY id"
O["viewport"] = f"""
SELECT {COLS} FROM (SELECT * FROM jobs_fx WHERE lng BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}
  AND wage_min >= 16 AND wage_max <= 30 ORDER BY posted_at DESC NULLS FIRST, id LIMIT 100)"""


def sphere(a, b, c, d):
    return (
        f"(2 * {X.EARTH_MEAN} * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin(radians({d} - {b}) / 2), 2)))) / 1000.0)"
    )


_F = "(1.0 / 298.257223563)"


def reduced(lat):
    return f"atan((1 - {_F}) * tan(radians({lat})))"


def central(a, b, c, d):
    return (
        f"(2 * asin(least(1.0, sqrt(pow(sin(({reduced(c)} - {reduced(a)}) / 2), 2) + cos({reduced(a)}) * cos({reduced(c)})"
        f" * pow(sin(radians({d} - {b}) / 2), 2)))))"
    )


def ellipsoid(a, b, c, d, s="sg"):
    """Lambert in its textbook form; ``s`` is the central angle."""
    p, q = f"(({reduced(a)} + {reduced(c)}) / 2)", f"(({reduced(c)} - {reduced(a)}) / 2)"
    x = f"(({s} - sin({s})) * pow(sin({p}), 2) * pow(cos({q}), 2) / pow(cos({s} / 2), 2))"
    y = f"(({s} + sin({s})) * pow(cos({p}), 2) * pow(sin({q}), 2) / pow(sin({s} / 2), 2))"
    return f"(CASE WHEN {s} = 0 THEN 0 ELSE 6378137.0 * ({s} - {_F} / 2 * ({x} + {y})) END)"


_a = ("lat", "lng", str(CENTER[0]), f"({CENTER[1]})")
O["nearby"] = f"""
SELECT {COLS}, round(distance_km, 6) AS distance_km FROM (
  SELECT *, {sphere(*_a)} AS distance_km FROM (SELECT *, {central(*_a)} AS sg FROM jobs_fx WHERE category = 'retail')
  WHERE {ellipsoid(*_a)} <= {CENTER[2] * 1000} ORDER BY distance_km, id LIMIT 200)"""
O["viewport_copy"], O["nearby_copy"] = O["viewport"], O["nearby"]
_flt = "SELECT id, title, wage_min, wage_max, category FROM jobs_fx WHERE "
O["filter_wage_min"] = _flt + "wage_min >= 20"
O["filter_wage_max"] = _flt + "wage_max <= 20"
O["filter_category"] = _flt + "category = 'retail'"
O["filter_category_set"] = _flt + "category IN ('retail', 'cleaning')"
O["filter_text"] = _flt + "lower(title) LIKE '%urgent%'"
_lim = "coalesce(lim, 100) BETWEEN 1 AND 500 AND coalesce(wage_min, 0) >= 0 AND coalesce(wage_max, 0) >= 0"
O["validate_viewports"] = f"""
SELECT q_id, CASE WHEN min_lng >= max_lng OR min_lat >= max_lat THEN 'INVALID_BBOX' ELSE 'INVALID_COORDINATES' END AS code,
  'request refused' AS message FROM viewports_fx
WHERE min_lng >= max_lng OR min_lat >= max_lat OR NOT ({_lim} AND zoom BETWEEN 0 AND 20)"""
_cok = f"lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND radius_km BETWEEN 0.1 AND 50 AND {_lim}"
O["validate_centers"] = f"SELECT q_id, 'INVALID_COORDINATES' AS code, 'request refused' AS message FROM centers_fx WHERE NOT ({_cok})"
O["mappable"] = "SELECT id, round(lat,6) AS lat, round(lng,6) AS lng FROM jobs_fx WHERE lat <> 0 AND lng <> 0"
O["wage_sort"] = "SELECT id, wage_max FROM jobs_fx ORDER BY wage_max DESC NULLS LAST, id"
O["review_queue"] = """
SELECT id AS job_id, 'low_confidence' AS reason, round(confidence,6) AS confidence, round(lat,6) AS lat, round(lng,6) AS lng,
  'pending' AS status FROM jobs_fx WHERE confidence < 0.6"""
O["blocklist"] = """
SELECT id, source_url FROM jobs_fx j WHERE NOT EXISTS (SELECT 1 FROM blocklist_fx b WHERE b.source_url = j.source_url)
  AND NOT EXISTS (SELECT 1 FROM blocklist_fx b WHERE b.host = regexp_extract(j.source_url, '://([^/]+)/', 1))"""
O["favorites"] = f"""
SELECT DISTINCT user_id, j.id, title, {ts('posted_at')} AS posted_at FROM favorites_fx f JOIN jobs_fx j ON f.job_id = j.id"""
_ap = "coalesce(c.status = 'approved' AND suggested_lat IS NOT NULL AND suggested_lng IS NOT NULL, false)"
O["apply_review"] = f"""
SELECT id, round(CASE WHEN {_ap} THEN suggested_lat ELSE lat END, 6) AS lat, round(CASE WHEN {_ap} THEN suggested_lng ELSE lng END, 6) AS lng,
  {_ap} AS reviewed FROM jobs_fx j LEFT JOIN corrections_fx c ON c.job_id = j.id"""
O["review_history"] = """
SELECT job_id, status, reason, round(lat,6) AS old_lat, round(lng,6) AS old_lng,
  CASE WHEN status = 'approved' THEN round(suggested_lat,6) END AS new_lat, CASE WHEN status = 'approved' THEN round(suggested_lng,6) END AS new_lng
FROM corrections_fx c JOIN jobs_fx j ON j.id = c.job_id WHERE status IN ('approved', 'hold')"""
_days = f"CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 86400000000.0) AS BIGINT)"
AGE = f"""CASE WHEN posted_at IS NULL THEN '' WHEN {_days} = 0 THEN '오늘' WHEN {_days} = 1 THEN '어제'
  WHEN {_days} < 7 THEN concat({_days}, '일 전') WHEN {_days} < 30 THEN concat(CAST(floor({_days} / 7.0) AS BIGINT), '주 전')
  ELSE concat(CAST(floor({_days} / 30.0) AS BIGINT), '개월 전') END"""
O["freshness"] = f"SELECT id, {AGE} AS age_label FROM jobs_fx"
O["present"] = f"""
SELECT id, CASE WHEN title IS NULL OR title = '' THEN '제목 없음' ELSE title END AS title_label,
  CASE WHEN wage_min <> 0 AND wage_max <> 0 THEN concat('$', wage_min, ' - $', wage_max, '/hr') WHEN wage_min <> 0 THEN concat('$', wage_min, '+/hr')
    WHEN wage_max <> 0 THEN concat('Up to $', wage_max, '/hr') ELSE '시급 미표시' END AS wage_label,
  confidence < 0.7 AS low_confidence,
  CASE WHEN confidence >= 0.9 THEN '매우 높음' WHEN confidence >= 0.7 THEN '높음' WHEN confidence >= 0.5 THEN '보통' ELSE '낮음' END AS confidence_label,
  CASE WHEN confidence >= 0.7 THEN 'green' WHEN confidence >= 0.5 THEN 'yellow' ELSE 'red' END AS confidence_color,
  concat(printf('%.1f', (id % 977) / CAST(7 AS DOUBLE)), 'km') AS distance_label, {AGE} AS age_label,
  CASE WHEN posted_at IS NULL THEN '날짜 정보 없음' ELSE concat(year(posted_at), '년 ', month(posted_at), '월 ', day(posted_at), '일') END AS date_label,
  CASE WHEN lat <> 0 AND lng <> 0 THEN concat(printf('%.6f', lat), ', ', printf('%.6f', lng)) ELSE '' END AS coordinate_label
FROM jobs_fx"""
_vocab = ", ".join(f"({i}, '{v}', '{t}')" for i, (v, t) in enumerate(X.CATEGORY_LABELS, 1))
O["category_counts"] = f"""
SELECT prio, v.category, label, (SELECT count(*) FROM jobs_fx j WHERE j.category = v.category) AS n
FROM (VALUES {_vocab}) AS v(prio, category, label)"""
O["confidence_kpi"] = """
SELECT region_hint, 0 AS is_total, count(*) AS jobs, round(avg(confidence), 6) AS mean_confidence FROM jobs_fx GROUP BY region_hint
UNION ALL SELECT NULL, 1, count(*), round(avg(confidence), 6) FROM jobs_fx"""

# --- many requests -------------------------------------------------------------------
_bbox_ok = f"min_lng < max_lng AND min_lat < max_lat AND {_lim}"
_opt = """(v.wage_min IS NULL OR j.wage_min >= v.wage_min) AND (v.wage_max IS NULL OR j.wage_max <= v.wage_max)
  AND (v.category IS NULL OR v.category = '' OR j.category = v.category)"""


def boxed(select: str, extra: str = "", source: str = "jobs_fx") -> str:
    return f"""SELECT {select} FROM (SELECT *, coalesce(lim, 100) AS l FROM viewports_fx WHERE {_bbox_ok} {extra}) v
  JOIN {source} j ON j.lng >= v.min_lng AND j.lng <= v.max_lng AND j.lat >= v.min_lat AND j.lat <= v.max_lat WHERE {_opt}"""


_pairs = boxed("v.q_id, v.l, j.*, row_number() OVER (PARTITION BY v.q_id ORDER BY j.posted_at DESC NULLS FIRST, j.id) AS rn")
O["viewport_batch"] = f"""
SELECT q_id, rn, id, round(lat,6) AS lat, round(lng,6) AS lng, wage_min, category, {ts('posted_at')} AS posted_at FROM ({_pairs}) WHERE rn <= l"""
O["viewport_page"] = f"SELECT q_id, CAST((rn - 1) // 20 + 1 AS INT) AS page, rn, id FROM ({_pairs}) WHERE rn <= l"
_meta = f"""SELECT q_id, count(*) AS n FROM ({boxed('v.q_id')}) GROUP BY q_id"""
O["viewport_meta"] = f"""
SELECT v.q_id, least(coalesce(n, 0), coalesce(lim, 100)) AS count, least(coalesce(n, 0), coalesce(lim, 100)) AS total, coalesce(n, 0) AS matching
FROM viewports_fx v LEFT JOIN ({_meta}) m ON m.q_id = v.q_id WHERE {_bbox_ok}"""
_b = ("j.lat", "j.lng", "v.lat", "v.lng")
# the box around a circle only saves time: 0.5 degrees of latitude are 55 km, 0.9 of longitude at 49.5 north 65 km
_circle = f"""SELECT * FROM (SELECT v.q_id, v.l, v.radius_km, v.lat AS c_lat, v.lng AS c_lng, j.id, j.lat, j.lng, j.category, {central(*_b)} AS sg
  FROM (SELECT *, coalesce(lim, 100) AS l FROM centers_fx WHERE {_cok}) v JOIN jobs_fx j
  ON abs(j.lat - v.lat) < 0.5 AND abs(j.lng - v.lng) < 0.9 WHERE {_opt}) WHERE {ellipsoid('lat', 'lng', 'c_lat', 'c_lng')} <= radius_km * 1000"""
O["nearby_batch"] = f"""
SELECT q_id, rn, id, round(lat,6) AS lat, round(lng,6) AS lng, category, round(distance_km,6) AS distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance_km, id) AS rn FROM (
    SELECT *, {sphere('lat', 'lng', 'c_lat', 'c_lng')} AS distance_km FROM ({_circle}))) WHERE rn <= l"""
O["nearby_meta"] = f"""
SELECT v.q_id, least(coalesce(n, 0), coalesce(lim, 100)) AS count, least(coalesce(n, 0), coalesce(lim, 100)) AS total,
  round(lat,6) AS lat, round(lng,6) AS lng, round(radius_km,6) AS radius_km
FROM centers_fx v LEFT JOIN (SELECT q_id, count(*) AS n FROM ({_circle}) GROUP BY q_id) m ON m.q_id = v.q_id WHERE {_cok}"""
_search = f"""{_opt} AND (v.q_id % 4 <> 1 OR j.category IN ('retail', 'cleaning'))
  AND (v.q_id % 6 NOT IN (1, 2, 3) OR contains(lower(j.title), CASE v.q_id % 6 WHEN 1 THEN 'urgent' WHEN 2 THEN '5-l' ELSE 'h' END))"""
O["viewport_search"] = f"""
SELECT q_id, rn, id, title, category, {ts('posted_at')} AS posted_at FROM ({_pairs.replace(_opt, _search)}) WHERE rn <= l"""
O["viewport_search_meta"] = O["viewport_meta"].replace(_opt, _search)
O["nearby_search"] = O["nearby_batch"].replace(_opt, _search).replace("j.id, j.lat, j.lng, j.category", "j.id, j.lat, j.lng, j.title, j.category").replace(
    "round(lat,6) AS lat, round(lng,6) AS lng, category", "title, category")
_zc = "(70.3125 / pow(2, zoom))"


def grid(zoom: str, lng: str = "lng", lat: str = "lat") -> str:
    size = f"(70.3125 / pow(2, {zoom}))"
    return (
        f"concat_ws('/', {zoom}, CAST(floor(({lng} + 180.0) / {size}) AS BIGINT), CAST(floor(({lat} + 90.0) / {size}) AS BIGINT))"
    )


_gc = f"""SELECT q_id, zoom, {grid('zoom')} AS cluster_id, count(*) AS count, round(avg(lat),6) AS center_lat, round(avg(lng),6) AS center_lng,
  round(min(lng),6) AS min_lng, round(min(lat),6) AS min_lat, round(max(lng),6) AS max_lng, round(max(lat),6) AS max_lat
FROM ({boxed('v.q_id, v.zoom, j.lat, j.lng', 'AND zoom BETWEEN 0 AND 20')}) GROUP BY ALL"""
O["clusters_grid"] = _gc
O["clusters_meta"] = f"""
SELECT v.q_id, v.zoom, coalesce(n, 0) AS cluster_count FROM viewports_fx v
LEFT JOIN (SELECT q_id, count(*) AS n FROM ({_gc}) GROUP BY q_id) c ON c.q_id = v.q_id WHERE {_bbox_ok} AND v.zoom BETWEEN 0 AND 20"""
O["cluster_children"] = f"SELECT {grid('11')} AS cluster_id, id AS child_id FROM jobs_fx"
O["cluster_children_batch"] = f"""
WITH kids AS ({boxed(f"v.q_id, j.id AS child_id, {grid('v.zoom', 'j.lng', 'j.lat')} AS cluster_id", 'AND zoom BETWEEN 0 AND 20')}),
sized AS (SELECT q_id, cluster_id, row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, cluster_id) AS r FROM kids GROUP BY q_id, cluster_id)
SELECT kids.* FROM kids JOIN sized USING (q_id, cluster_id) WHERE r = 1"""
O["cluster_sample"] = f"""
SELECT cluster_id, rn, id, {ts('posted_at')} AS posted_at FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY posted_at DESC NULLS FIRST, id) AS rn
  FROM (SELECT *, {grid('12')} AS cluster_id FROM jobs_fx)) WHERE rn <= 3"""

# --- places ------------------------------------------------------------------------------


def center(c: str) -> str:
    """[lat, lng] of the first known city, else of Vancouver; NULL without hint."""
    arms = " ".join(f"WHEN contains(lower({c}), '{n.lower()}') THEN [{a}, {b}]" for n, a, b in X.CITY_CENTERS)
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL {arms} ELSE [49.2827, -123.1207] END"


O["region_center"] = f"""
SELECT region_hint, count(*) AS n, CAST(({center('region_hint')})[1] AS DOUBLE) AS lat, CAST(({center('region_hint')})[2] AS DOUBLE) AS lng,
  CASE WHEN coalesce(region_hint, '') <> '' THEN CAST(0.5 AS DOUBLE) END AS confidence FROM incoming_fx GROUP BY region_hint"""


def query_of(text: str, hint: str) -> str:
    known = " OR ".join(f"contains({strip(text)}, '{w}')" for w in X.PROVINCE_WORDS)
    return (
        f"CASE WHEN coalesce({strip(text)}, '') = '' THEN NULL "
        f"WHEN coalesce({hint}, '') <> '' AND NOT contains(lower({strip(text)}), lower({hint})) THEN {strip(text)} || ', ' || {hint} || ', Canada' "
        f"WHEN {known} THEN {strip(text)} ELSE {strip(text)} || ', Canada' END"
    )


def place_key(c: str) -> str:
    out = collapse(f"lower({c})")
    for short, full in (("st", "street"), ("ave", "avenue"), ("rd", "road"), ("dr", "drive"), ("blvd", "boulevard"), ("ln", "lane")):
        out = f"regexp_replace({out}, '\\b{short}\\b\\.?', '{full}', 'g')"
    return out


def ladder(i: str) -> str:
    return f"CASE WHEN {i} > 0.7 THEN 0.9 WHEN {i} > 0.5 THEN 0.8 WHEN {i} > 0.3 THEN 0.7 ELSE 0.6 END"


O["geocode_query"] = f"SELECT DISTINCT location_text, region_hint, {query_of('location_text', 'region_hint')} AS query FROM incoming_fx"
O["norm_location"] = f"""
SELECT name, {place_key('name')} AS key FROM gazetteer_fx UNION SELECT location_text, {place_key('location_text')} FROM incoming_fx"""
O["confidence"] = f"""
SELECT name, round(importance,6) AS importance, CAST({ladder('coalesce(importance, 0)')} AS DOUBLE) AS confidence FROM gazetteer_fx"""


def geocoded(source: str) -> str:
    """CTE text: ``geo`` = rows of ``source`` with lat, lng, confidence."""
    return f"""
best AS (SELECT * FROM (SELECT {place_key('name')} AS key, lat, lng, importance,
    row_number() OVER (PARTITION BY {place_key('name')} ORDER BY importance DESC, lat, lng) AS r FROM gazetteer_fx) WHERE r = 1),
asked AS (SELECT *, {query_of('location_text', 'region_hint')} AS query FROM {source}),
keyed AS (SELECT *, {place_key('query')} AS whole, {place_key("split_part(query, ',', 1)")} AS part, {center('region_hint')} AS ctr FROM asked),
geo AS (SELECT k.* EXCLUDE (query, whole, part, ctr),
  CAST(coalesce(a.lat, b.lat, ctr[1]) AS DOUBLE) AS lat, CAST(coalesce(a.lng, b.lng, ctr[2]) AS DOUBLE) AS lng,
  CAST(CASE WHEN a.lat IS NOT NULL THEN {ladder('a.importance')} WHEN b.lat IS NOT NULL THEN {ladder('b.importance')}
    WHEN ctr IS NOT NULL THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence
  FROM keyed k LEFT JOIN best a ON a.key = k.whole LEFT JOIN best b ON b.key = k.part)"""


O["geocode"] = f"""WITH {geocoded('incoming_fx')}
SELECT source_url, seq, location_text, region_hint, round(lat,6) AS lat, round(lng,6) AS lng, confidence FROM geo"""
_term = "lower(term)"
_term = f"trim(regexp_replace({_term}, '[{W}]+', ' ', 'g'), ' ')"
for _s, _l in (("st", "street"), ("ave", "avenue"), ("rd", "road"), ("dr", "drive"), ("blvd", "boulevard"), ("ln", "lane")):
    _term = f"regexp_replace({_term}, '\\b{_s}(?:\\.|([^a-z0-9]))', '{_l}\\1', 'g')"
O["place_search"] = f"""
WITH t AS (SELECT q_id, {_term} AS term FROM terms_fx), g AS (SELECT DISTINCT {place_key('name')} AS key, name, lat, lng, importance FROM gazetteer_fx),
hits AS (SELECT term, name, lat, lng, importance, row_number() OVER (PARTITION BY term ORDER BY importance DESC, name, lat, lng) AS rank
  FROM (SELECT DISTINCT term FROM t WHERE term <> '') JOIN g ON contains(' ' || key, ' ' || term))
SELECT q_id, t.term, rank, name, round(lat,6) AS lat, round(lng,6) AS lng, round(importance,6) AS importance
FROM t JOIN hits h ON h.term = t.term WHERE rank <= 5"""

# --- ingest -----------------------------------------------------------------------------------
_code = """CASE WHEN lat IS NULL OR lng IS NULL THEN 'GEOCODING_FAILED'
  WHEN abs(coalesce(wage_min, 0)) > 2147483647 OR abs(coalesce(wage_max, 0)) > 2147483647 THEN 'INTERNAL_ERROR' END"""
_judged = f"{geocoded('incoming_fx')}, judged AS (SELECT *, {_code} AS code FROM geo)"
_last = """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY seq DESC, msgid DESC, title DESC,
  wage_min DESC NULLS LAST, wage_max DESC NULLS LAST, lat DESC, lng DESC, category DESC) AS r FROM judged WHERE code IS NULL) WHERE r = 1)"""
O["ingest_rejects"] = f"""WITH {_judged}
SELECT source_url, seq, code, location_text AS details FROM judged WHERE code IS NOT NULL
UNION ALL SELECT url, NULL, 'FETCH_FAILED', NULL FROM raw_pages_fx WHERE html IS NULL"""  # completed below, behind SEGMENTS
O["upsert_last_wins"] = f"""WITH {_judged} {_last}
SELECT source_url, seq, msgid, title, CAST(wage_min AS INT) AS wage_min, CAST(wage_max AS INT) AS wage_max, round(lat,6) AS lat, round(lng,6) AS lng,
  category, confidence, {ts('posted_at')} AS posted_at, region_hint FROM last"""
_fields = ["msgid", "title", "wage_min", "wage_max", "lat", "lng", "category", "confidence", "posted_at", "region_hint"]


def merged(name: str, src: str) -> str:
    pick = ", ".join(f"CASE WHEN n.source_url IS NOT NULL THEN n.{c} ELSE e.{c} END AS {c}" for c in _fields)
    return f""", {name} AS (SELECT coalesce(e.source_url, n.source_url) AS source_url, {pick},
  CASE WHEN n.source_url IS NOT NULL THEN e.source_url IS NULL END AS created FROM jobs_fx e FULL OUTER JOIN {src} n ON e.source_url = n.source_url)"""


_mview = f"""SELECT source_url, msgid, title, CAST(wage_min AS INT) AS wage_min, CAST(wage_max AS INT) AS wage_max, round(lat,6) AS lat, round(lng,6) AS lng,
  category, round(confidence,6) AS confidence, {ts('posted_at')} AS posted_at, region_hint, created FROM merged"""
O["upsert"] = f"WITH {_judged} {_last} {merged('merged', 'last')} {_mview}"
_alert = boxed("v.q_id, j.source_url, round(j.lat,6) AS lat, round(j.lng,6) AS lng", source="(SELECT * FROM merged WHERE created)")
O["area_alerts"] = f"WITH {_judged} {_last} {merged('merged', 'last')} {_alert}"
O["area_alert_counts"] = f"""WITH {_judged} {_last} {merged('merged', 'last')} SELECT v.q_id, coalesce(n, 0) AS n_new,
  min(v.q_id) OVER (PARTITION BY min_lng, min_lat, max_lng, max_lat, wage_min, wage_max, coalesce(category, '')) AS lead_id
  FROM viewports_fx v LEFT JOIN (SELECT q_id, count(*) AS n FROM ({_alert}) GROUP BY q_id) m ON m.q_id = v.q_id WHERE {_bbox_ok}"""
O["crawl_log"] = """
SELECT coalesce(k.bbs, d.bbs) AS bbs, coalesce(greatest(known, done), known, done, 0) AS last_seen_msgid FROM
 (SELECT bbs, max(last_seen_msgid) AS known FROM crawl_log_fx GROUP BY bbs) k FULL OUTER JOIN
 (SELECT bbs, max(msgid) FILTER (ok = 1) AS done FROM crawl_events_fx GROUP BY bbs) d ON k.bbs = d.bbs"""
O["crawl_counts"] = "SELECT bbs, count(*) FILTER (ok = 1) AS succeeded, count(*) FILTER (ok = 0) AS failed FROM crawl_events_fx GROUP BY bbs"
O["crawl_error_rate"] = """
SELECT bbs, 0 AS all_boards, count(*) AS attempts, round(avg(1 - ok), 6) AS error_rate FROM crawl_events_fx GROUP BY bbs
UNION ALL SELECT NULL, 1, count(*), round(avg(1 - ok), 6) FROM crawl_events_fx"""
O["crawl_finished"] = """
WITH d AS (SELECT DISTINCT bbs, msgid FROM crawl_events_fx WHERE ok = 1),
i AS (SELECT *, msgid - row_number() OVER (PARTITION BY bbs ORDER BY msgid) AS island FROM d)
SELECT bbs, min(msgid) AS first_msgid, max(msgid) AS last_msgid FROM i GROUP BY bbs, island"""
O["retry_queue"] = f"""
SELECT bbs, msgid, {ts('max(ingested_at)')} AS failed_at, count(*) AS failures FROM crawl_events_fx f WHERE ok = 0
  AND NOT EXISTS (SELECT 1 FROM crawl_events_fx s WHERE s.ok = 1 AND s.bbs = f.bbs AND s.msgid = f.msgid
    AND s.ingested_at >= (SELECT max(l.ingested_at) FROM crawl_events_fx l WHERE l.ok = 0 AND l.bbs = f.bbs AND l.msgid = f.msgid))
GROUP BY bbs, msgid"""
O["crawl_sessions"] = f"""
SELECT run_id, {ts('min(ingested_at)')} AS started_at, {ts('max(ingested_at)')} AS ended_at, count(*) AS processed, count(*) FILTER (ok = 0) AS failed
FROM crawl_events_fx GROUP BY run_id"""
O["regions_url"] = f"""
SELECT id, CASE WHEN starts_with(listing_url, '{OLD_HOSTS[0]}') THEN '{NEW_HOST}' || substr(listing_url, {len(OLD_HOSTS[0]) + 1}) ELSE listing_url END AS listing_url
FROM regions_fx"""
O["regions_migrate"] = f"""
SELECT id, CASE WHEN bbs = 4 THEN 'Vancouver' ELSE city END AS city, bbs,
  replace(replace(listing_url, '{OLD_HOSTS[0]}/listing.php', '{NEW_HOST}/listing.php'), '{OLD_HOSTS[1]}/listing.php', '{NEW_HOST}/listing.php') AS listing_url,
  center_lat, center_lng FROM regions_fx
UNION ALL SELECT max(id) + 1, 'Other Cities', 59, '{NEW_HOST}/listing.php?bbs=59', 49.2827, -123.1207 FROM regions_fx HAVING count(*) FILTER (bbs = 59) = 0"""
O["post_url"] = """
SELECT p.bbs, msgid, listing_url, concat(split_part(listing_url, '/listing.php', 1), '/topics.php?bbs=', p.bbs, '&msgid=', msgid) AS url
FROM posts_fx p JOIN (SELECT bbs, arg_min(listing_url, id) AS listing_url FROM regions_fx GROUP BY bbs) r ON r.bbs = p.bbs"""

# --- text ------------------------------------------------------------------------------------------


def whole_number(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(TRY_CAST({c} AS BIGINT), 9223372036854775807) END"


def numbers(body: str) -> str:
    return find_all(f"replace({body}, ',', '')", "(<D>+)")


def wage(body: str) -> str:
    n = numbers(body)
    return f"{whole_number(f'({n})[1]')} AS wage_min, {whole_number(f'({n})[-1]')} AS wage_max"


def category(title: str, body: str) -> str:
    t = f"lower(coalesce({title}, '') || ' ' || coalesce({body}, ''))"
    return "CASE " + " ".join(f"WHEN {any_in(t, w)} THEN '{n}'" for n, w in X.CATEGORY_WORDS) + " ELSE 'other' END"


def city(body: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({body}), '{c.lower()}') THEN '{c}'" for c in X.HINT_CITIES) + " END"


def posted(body: str) -> str:
    parts = [
        f"CAST(try_strptime({find(body, '(' + p + ')')}, '{f}') AS TIMESTAMP)"
        for (p, _), f in zip(X.DATE_PATTERNS, ("%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y"))
    ]
    return f"coalesce({', '.join(parts)})"


O["wage"] = f"SELECT msgid, {wage('body')} FROM posts_fx"
_anch = (
    r"(?i)\$[<W>]*(<D>+)(?:\.<D>+)?(?:[<W>]*[-~–][<W>]*\$?[<W>]*(<D>+)(?:\.<D>+)?)?[<W>]*(?:/|per)[<W>]*(?:hour|hr|h)(?:[^A-Za-z]|$)"
)
O["wage_anchored"] = f"""
SELECT msgid, {whole_number(find('body', _anch, 1))} AS wage_min,
  {whole_number(f"coalesce({find('body', _anch, 2)}, {find('body', _anch, 1)})")} AS wage_max FROM posts_fx"""
O["category"] = f"SELECT msgid, {category('title', 'body')} AS category FROM posts_fx"
O["city_hint"] = f"SELECT msgid, {city('body')} AS city FROM posts_fx"
O["posted_date"] = f"SELECT msgid, {ts(posted('body'))} AS posted_at FROM posts_fx"

_L = "[A-Za-z<W>]"
_tail = rf"[,<W>]+{_L}+(?:,[<W>]*)?"
_st = rf"<D>+[A-Za-z]?[<W>]+{_L}+"
_street = [
    rf"(?i)({_st}(?:{X.STREET_WORDS_LONG}){_tail}(?:{X.POSTCODE}|{X.PROVINCES})?)",
    rf"(?i)({_st}(?:{X.STREET_WORDS})[,<W>]+{_L}+)",
    rf"(?i)({_L}+(?:{X.STREET_WORDS}){_tail}(?:{X.POSTCODE}|{X.PROVINCES})?)",
]
_areas = [
    rf"(?i)([A-Z][a-z]+(?:{X.AREA_ENDINGS})[,<W>]+(?:{X.AREA_CITIES}))",
    rf"(?i)([A-Z][a-z]+(?:・|/|[<W>]+)[A-Z][a-z]+(?:{X.AREA_WORDS}))",
]
_store_st = (
    rf"(?i)([A-Za-z<W>&]+(?:{'|'.join(X.STORE_WORDS_ADDRESS)})[,<W>]+)?({_st}(?:{X.STREET_WORDS}){_tail}(?:{X.POSTCODE})?)"
)


def address_ctes(source: str, key: str) -> str:
    """CTE text: ``addr`` = key and list ``a`` of addresses of ``source``.body."""
    labelled = "list_concat(" + ", ".join(find_all("body", rf"(?i){p}([^\n]+)") for p in X.ADDRESS_LABELS) + ")"
    streets = "list_concat(" + ", ".join(find_all("body", p) for p in _street) + ")"
    areas = "list_concat(" + ", ".join(find_all("body", p) for p in _areas) + ")"
    return f"""
found AS (SELECT {key}, {labelled} AS lab, {streets} AS str, {areas} AS are, {find_all('body', _store_st, 1)} AS s1, {find_all('body', _store_st, 2)} AS s2 FROM {source}),
clean AS (SELECT {key}, list_concat(
  list_filter(list_transform(lab, lambda x: {collapse('x')}), lambda x: length(x) > 5 AND NOT contains(x, '@') AND NOT contains(lower(x), 'http')),
  list_filter(list_transform(str, lambda x: {strip('x')}), lambda x: length(x) > 10),
  list_filter(list_transform(are, lambda x: {strip('x')}), lambda x: length(x) > 5),
  list_filter(list_transform(s2, lambda x, i: trim({strip('s1[i]')} || ' ' || {strip('x')}, ' ')), lambda x: length(x) > 10)) AS l FROM found),
addr AS (SELECT {key}, {distinct_ci('l')} AS a FROM clean)"""


_unnest = "SELECT msgid, unnest(range(len(a))) AS pos, unnest(a) AS address FROM addr"
O["addresses"] = f"WITH {address_ctes('posts_fx', 'msgid')} {_unnest}"
O["multi_store"] = f"WITH {address_ctes('posts_fx', 'msgid')} SELECT msgid, CAST(len(a) AS BIGINT) AS n_addresses FROM addr WHERE len(a) > 1"


def store(title: str, body: str) -> str:
    parts = [f"CASE WHEN {any_in(f'lower({title})', X.STORE_WORDS)} THEN {title} END"]
    pats = [rf"(?i){p}([^\n]+)" for p in X.STORE_LABELS] + [rf"(?i)([A-Za-z<W>&]+(?:{'|'.join(X.STORE_WORDS)}))"]
    for p in pats:
        s = strip(find(body, p))
        parts.append(f"CASE WHEN length({s}) > 3 THEN {s} END")
    return f"coalesce({', '.join(parts)})"


O["store_name"] = f"SELECT msgid, {store('title', 'body')} AS store FROM posts_fx"


def located(address: str, st: str, hint: str) -> str:
    complete = f"({any_in(f'lower({address})', X.ADDRESS_CITIES)} OR contains(lower({address}), lower({hint})))"
    return (
        f"CASE WHEN {address} IS NOT NULL THEN CASE WHEN {hint} IS NULL OR {complete} THEN {address} ELSE {address} || ', ' || {hint} || ', BC' END "
        f"WHEN {st} IS NOT NULL AND {hint} IS NOT NULL THEN {st} || ', ' || {hint} || ', BC' WHEN {hint} IS NOT NULL THEN {hint} || ', BC' END"
    )


O["location_text"] = f"""
WITH {address_ctes('posts_fx', 'msgid')},
f AS (SELECT p.msgid, a[1] AS ad, {store('title', 'body')} AS st, {city('body')} AS hint FROM posts_fx p JOIN addr USING (msgid))
SELECT msgid, {located('ad', 'st', 'hint')} AS location_text FROM f"""

_phone = r"\b(?:1[-. ]?)?\(?([0-9]{3})\)?[-. ]{0,2}([0-9]{3})[-. ]?([0-9]{4})\b"
_mail = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_keys = f"""
raw AS (SELECT source_url, bbs, msgid, list_concat(
  list_transform({find_all('body', _phone, 0)}, lambda x: 'tel:' || right(regexp_replace(x, '[^0-9]', '', 'g'), 10)),
  list_transform({find_all('body', _mail)}, lambda x: 'mail:' || lower(x))) AS c FROM posts_fx),
keys AS (SELECT DISTINCT source_url, bbs, msgid, sha256(unnest(c)) AS contact FROM raw)"""
O["contact_keys"] = f"WITH {_keys} SELECT * FROM keys"
O["cross_board_dups"] = f"""WITH {_keys},
g AS (SELECT contact, count(*) AS posts, count(DISTINCT bbs) AS boards, min(struct_pack(m := msgid, u := source_url)).u AS canonical_url FROM keys GROUP BY contact HAVING count(DISTINCT bbs) > 1)
SELECT k.contact, source_url, bbs, canonical_url, posts, boards, source_url = canonical_url AS is_canonical FROM keys k JOIN g ON g.contact = k.contact"""
O["dup_ratio"] = f"""WITH {_keys},
k AS (SELECT coalesce(min(contact), p.source_url) AS k FROM posts_fx p LEFT JOIN keys USING (source_url) GROUP BY p.source_url)
SELECT count(*) AS posts, count(DISTINCT k) AS keys, round(1 - count(DISTINCT k) / count(*), 6) AS dup_share FROM k"""

# --- pages -------------------------------------------------------------------------------------------
_invisible = r"(?is)<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|<!--.*?-->|<!doctype[^>]*>"


def visible(c: str) -> str:
    return f"regexp_replace({c}, '{rx(_invisible)}', '', 'g')"


def tag_text(c: str) -> str:
    out = f"regexp_replace({c}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for name, ch in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{ch}')"
    return out


O["strip_html"] = f"SELECT url, {tag_text(visible('html'))} AS text FROM raw_pages_fx"
_listing = f"""SELECT listing_id, bbs, list_reverse_sort(list_distinct(list_transform(list_concat(
  {find_all('html', 'topics[.]php[?]msgid=(<D>+)')}, {find_all(tag_text(visible('html')), 'No[.](<D>+)')}, {find_all('html', 'msgid=(<D>+)')}),
  lambda x: TRY_CAST(x AS BIGINT)))) AS ids FROM listings_fx"""
O["listing_msgids"] = f"SELECT listing_id, unnest(range(len(ids))) AS pos, unnest(ids) AS msgid FROM ({_listing})"
O["new_msgids"] = f"""
WITH i AS (SELECT DISTINCT bbs, unnest(ids) AS msgid FROM ({_listing}))
SELECT i.bbs, msgid FROM i LEFT JOIN (SELECT bbs, max(last_seen_msgid) AS seen FROM crawl_log_fx GROUP BY bbs) c ON c.bbs = i.bbs WHERE msgid > coalesce(seen, 0)"""

_h2 = r"(?is)<h2\b[^>]*>(.*?)</h2"
_block = r"(?i)</?(?:p|div|td|th|tr|table|tbody|span|li|ul|ol|br|hr|h[1-6]|section|article|main|body|html)\b[^>]*>"
_cont = []
for _t, _at, _w in X.BODY_CONTAINERS:
    _cont.append((_t, rf"(?is)<{_t}\b[^>]*>(.*)" if _at is None
        else rf"(?is)<{_t}\b[^>]*?\s{_at}\s*=\s*[\"']?[^\"'>]*(?:{_w})[^>]*>(.*)"))


def balanced(c: str, tag: str) -> str:
    """Text up to the closing tag that belongs to the opening one before ``c``; NULL without it."""
    pieces = f"string_split(regexp_replace(replace({c}, chr(2), ' '), '(?i)(</?{tag}[^a-zA-Z0-9-])', chr(2) || '\\1', 'g'), chr(2))"
    depth = "1 + coalesce(list_sum(list_transform(s[2:i], lambda y: CASE WHEN starts_with(y, '</') THEN -1 ELSE 1 END)), 0)"
    end = f"list_filter(range(2, len(s) + 1), lambda i: {depth} = 0)[1]"
    return f"list_transform([{pieces}], lambda s: CASE WHEN {end} IS NOT NULL THEN array_to_string(s[1:{end} - 1], '') END)[1]"


_ct = [tag_text(balanced(find("page", p), t)) for t, p in _cont]
_short = "coalesce(length({0}), 0) < 50"
_lead = r"[^<\p{L}]*?"
SEGMENTS = f"""
pg AS (SELECT url, bbs, fetched_at, {visible('html')} AS page FROM raw_pages_fx WHERE html IS NOT NULL),
cut0 AS (SELECT *, TRY_CAST({find('url', 'msgid=(<D>+)')} AS BIGINT) AS own, CASE WHEN regexp_matches(page, '{rx('(?i)>[<W>]*No[.]<D>+([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}') THEN regexp_replace(page, '{rx('(?i)>(' + _lead + 'No[.]<D>+)([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}', '>' || chr(1) || '\\1\\2', 'g') ELSE page END AS c FROM pg),
cut AS (SELECT *, string_split(CASE WHEN own IS NULL OR regexp_matches(c, '(?i)' || chr(1) || '{_lead}No[.]0*' || own || '([^\\p{{L}}\\p{{N}}_]|$)') THEN c
  ELSE regexp_replace(c, '(?is)(>(?:[^<>' || chr(1) || ']*?[^<>\\p{{L}}\\p{{N}}_' || chr(1) || '])?)(No[.]0*' || own || '(?:[^\\p{{L}}\\p{{N}}_]|$))', '\\1' || chr(1) || '\\2') END, chr(1)) AS parts FROM cut0),
seg0 AS (SELECT url, bbs, fetched_at, page, unnest(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE [NULL] END) AS segment,
  unnest(CASE WHEN len(parts) > 1 THEN range(1, len(parts)) ELSE [0] END) AS pos FROM cut),
seg1 AS (SELECT *, TRY_CAST(CASE WHEN segment IS NULL THEN {find('url', 'msgid=(<D>+)')} ELSE {find('segment', '(?i)^' + _lead + 'No[.](<D>+)')} END AS BIGINT) AS msgid FROM seg0),
seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, msgid ORDER BY pos) AS r FROM seg1) WHERE r = 1),
a1 AS (SELECT *, nullif({strip(tag_text(find('segment', _h2)))}, '') AS h2, {strip(tag_text(find('page', _h2)))} AS ph2,
  list_transform(regexp_split_to_array(regexp_replace(regexp_replace(segment, '^[^<]*', ''), '{rx('(?is)<h2' + chr(92) + 'b[^>]*>.*?</h2[^>]*>')}', '<p>', 'g'), '{rx(_block)}'),
    lambda x: {strip(tag_text('x'))}) AS blocks,
  regexp_replace({tag_text('segment')}, '{rx('(?i)^' + _lead + 'No[.]<D>+[^' + chr(92) + 'n]*' + chr(92) + 'n')}', '') AS txt FROM seg),
a2 AS (SELECT *, coalesce(h2, CASE WHEN length(ph2) > 5 AND NOT starts_with(ph2, 'No.') THEN ph2 END) AS title,
  CASE WHEN h2 IS NOT NULL AND instr(txt, h2) > 0 THEN substr(txt, 1, instr(txt, h2) - 1) || substr(txt, instr(txt, h2) + length(h2)) ELSE txt END AS unt FROM a1),
a3 AS (SELECT *, CASE WHEN h2 IS NOT NULL THEN array_to_string(list_filter(blocks, lambda x, i: length(x) > 5 AND list_position(blocks, x) = i), ' ') END AS c1,
  {strip(f"coalesce({find('unt', '(?is)^(.+?)No[.]<D>+.*$')}, unt)")} AS c2,
  array_to_string(list_filter(blocks, lambda x: length(x) > 10 AND x IS DISTINCT FROM title), ' ') AS c3,
  coalesce({', '.join(f'CASE WHEN length({c}) > 50 THEN {c} END' for c in _ct)}, {', '.join(reversed(_ct))}) AS c4,
  {tag_text(f"coalesce({find('page', '(?is)<body' + chr(92) + 'b[^>]*>(.*)</body')}, page)")} AS c5 FROM a2),
b2 AS (SELECT *, CASE WHEN h2 IS NOT NULL AND {_short.format('c1')} THEN c2 ELSE c1 END AS t2,
  CASE WHEN h2 IS NULL THEN NULL WHEN {_short.format('c1')} THEN 'segment' ELSE 'blocks' END AS o2 FROM a3),
b3 AS (SELECT *, CASE WHEN {_short.format('t2')} AND c3 <> '' THEN c3 ELSE t2 END AS t3, CASE WHEN {_short.format('t2')} AND c3 <> '' THEN 'siblings' ELSE o2 END AS o3 FROM b2),
b4 AS (SELECT *, CASE WHEN {_short.format('t3')} AND c4 <> '' THEN c4 ELSE t3 END AS t4, CASE WHEN {_short.format('t3')} AND c4 <> '' THEN 'container' ELSE o3 END AS o4 FROM b3),
post AS (SELECT url, bbs, fetched_at, msgid, title, CASE WHEN {_short.format('t4')} AND c5 <> '' THEN c5 ELSE t4 END AS body,
  CASE WHEN {_short.format('t4')} AND c5 <> '' THEN 'page' ELSE o4 END AS body_source FROM b4)"""
O["ingest_rejects"] = O["ingest_rejects"].replace("WITH ", f"WITH {SEGMENTS},", 1) + """
UNION ALL SELECT url, NULL, 'PARSE_FAILED', NULL FROM post WHERE msgid IS NULL OR (coalesce(title, '') = '' AND coalesce(body, '') = '')"""
O["segment_posts"] = f"WITH {SEGMENTS} SELECT url, msgid, title, body, body_source FROM post"
O["body_fallback"] = f"""WITH {SEGMENTS}
SELECT body_source, count(*) AS posts, CAST(sum(coalesce(length(body), 0)) AS BIGINT) AS chars FROM post GROUP BY body_source"""
RECORDS = f"""{SEGMENTS},
named AS (SELECT concat(CASE WHEN contains(url, 'listing.php') THEN rtrim(split_part(url, 'listing.php', 1), '/') ELSE regexp_replace(url, '/[^/]*$', '') END,
  '/topics.php?bbs=', bbs, '&msgid=', msgid) AS source_url, msgid, title, coalesce(body, '') AS body,
  CAST(epoch(fetched_at) AS BIGINT) * 1048576 - (msgid % 1048576) AS seq FROM post
  WHERE msgid IS NOT NULL AND (coalesce(title, '') <> '' OR coalesce(body, '') <> '')),
numbered AS (SELECT row_number() OVER () AS k, * FROM named), {address_ctes('numbered', 'k')},
f AS (SELECT n.source_url, n.msgid, n.title, n.seq, {wage('body')}, {category('title', 'body')} AS category, {city('body')} AS region_hint,
  a[1] AS ad, {store('title', 'body')} AS st, {posted('body')} AS posted_at FROM numbered n JOIN addr USING (k)),
records AS (SELECT *, {located('ad', 'st', 'region_hint')} AS location_text FROM f)"""
O["page_records"] = f"""WITH {RECORDS}
SELECT source_url, msgid, title, wage_min, wage_max, category, region_hint, location_text, {ts('posted_at')} AS posted_at FROM records"""


# streams end where the batch form ends
O["stream_new_posts"] = "SELECT DISTINCT source_url, msgid FROM incoming_fx"
O["stream_crawl_metrics"] = f"""
WITH w AS (SELECT bbs, time_bucket(INTERVAL '15 minutes', ingested_at) AS s, count(*) AS attempts, count(*) FILTER (ok = 0) AS failed FROM crawl_events_fx GROUP BY ALL)
SELECT bbs, {ts('s')} AS window_start, attempts, failed, round(failed / attempts, 6) AS error_rate FROM w
WHERE s + INTERVAL '15 minutes' <= (SELECT max(ingested_at) - INTERVAL '30 minutes' FROM crawl_events_fx)"""
O["stream_alerts"] = boxed("v.q_id, j.source_url, round(j.lat,6) AS lat, round(j.lng,6) AS lng")
_page_geo = f"""{RECORDS}, {geocoded('records')}, judged AS (SELECT *, {_code} AS code FROM geo)"""
_page_merge = f"""{_page_geo} {_last} {merged('merged', 'last')}"""
O["stream_ingest"] = f"WITH {_page_merge} {_mview.replace(', created FROM', ' FROM')}"
_near = _circle.replace("jobs_fx j", "merged j").replace("j.id,", "j.source_url,")
O["crawl_to_search"] = f"""WITH {_page_merge},
near AS (SELECT *, {sphere('lat', 'lng', 'c_lat', 'c_lng')} AS distance_km FROM ({_near})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance_km, source_url) AS rn FROM near)
SELECT q_id, count(*) AS n, round(max(distance_km), 6) AS farthest_km FROM ranked WHERE rn <= l GROUP BY q_id"""


def all_oracles() -> dict[str, str]:
    return {k: for_duckdb(v) for k, v in O.items()}
