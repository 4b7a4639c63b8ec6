"""Input tables for the registered queries, derived from the given tables.

One SQL text per table, valid in Spark and in DuckDB. Base tables are written
``{orders}`` and so on, derived tables by name. Every derived table covers its
whole base table.
"""

from __future__ import annotations

import re

from postgeo.functions.fixed import CITY_CENTERS

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_CENTERS = ", ".join(f"({i}, '{c}', {lat}, {lng})" for i, (c, lat, lng) in enumerate(CITY_CENTERS, start=1))

VIEWS: dict[str, str] = {}

# stored postings; one in three sits on the exact city centre, as fallback points do
VIEWS["jobs_fx"] = """
SELECT o_orderkey AS id, o_orderkey AS msgid, CAST(o_orderkey % 20 AS INT) AS bbs,
  concat('https://bbs.example/topics.php?bbs=', CAST(o_orderkey % 20 AS STRING), '&msgid=', CAST(o_orderkey AS STRING)) AS source_url,
  CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'Vancouver' WHEN 1 THEN 'Burnaby' WHEN 2 THEN 'Richmond' ELSE NULL END AS region_hint,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
    ELSE concat('Help wanted ', o_orderpriority) END AS title,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0 ELSE CAST(14 + o_custkey % 12 AS INT) END AS wage_min,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(14 + o_custkey % 12 + o_orderkey % 9 AS INT) END AS wage_max,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(49.2827 AS DOUBLE) WHEN o_orderkey % 29 = 0 THEN CAST(0 AS DOUBLE)
    ELSE CAST(49 AS DOUBLE) + CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / CAST(20014 AS DOUBLE) END AS lat,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(-123.1207 AS DOUBLE)
    ELSE CAST(-123.3 AS DOUBLE) + CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / CAST(16681 AS DOUBLE) END AS lng,
  CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'restaurant' WHEN 1 THEN 'retail' WHEN 2 THEN 'hospitality'
    WHEN 3 THEN 'warehouse' WHEN 4 THEN 'construction' WHEN 5 THEN 'cleaning' ELSE 'other' END AS category,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.5 WHEN o_orderkey % 5 = 1 THEN 0.6 WHEN o_orderkey % 5 = 2 THEN 0.7
    WHEN o_orderkey % 5 = 3 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS posted_at,
  CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders}
"""

# ingest calls: several per address, half of them for addresses not yet stored
VIEWS["incoming_fx"] = """
SELECT concat('https://bbs.example/topics.php?bbs=', CAST(l_orderkey % 20 AS STRING), '&msgid=', CAST(l_orderkey AS STRING),
    CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE '&new=1' END) AS source_url,
  l_orderkey AS msgid,
  CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'Vancouver' WHEN 1 THEN 'Kelowna BC' WHEN 2 THEN 'Langley' WHEN 3 THEN ''
    WHEN 4 THEN NULL ELSE 'Toronto' END AS region_hint,
  concat('Position ', l_returnflag) AS title,
  CAST(l_quantity AS BIGINT) AS wage_min,
  CASE WHEN l_tax > CAST(0.07 AS DOUBLE) THEN CAST(6045551234 AS BIGINT) WHEN l_tax > CAST(0.06 AS DOUBLE) THEN NULL
    ELSE CAST(l_quantity AS BIGINT) + 5 END AS wage_max,
  CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '  '
    WHEN 2 THEN concat(CAST(100 + l_partkey % 1200 AS STRING), ' Main  St.')
    WHEN 3 THEN concat(CAST(100 + l_partkey % 1200 AS STRING), ' Main Street, Burnaby, BC') ELSE 'Victoria, BC' END AS location_text,
  CASE l_linestatus WHEN 'F' THEN 'retail' ELSE 'cleaning' END AS category,
  CAST(l_shipdate AS TIMESTAMP) AS posted_at,
  CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq
FROM {lineitem}
"""

VIEWS["gazetteer_fx"] = f"""
SELECT lower(city) AS name, CAST(a AS DOUBLE) AS lat, CAST(b AS DOUBLE) AS lng, CAST(prio AS DOUBLE) / CAST(20 AS DOUBLE) AS importance
FROM (VALUES {_CENTERS}) AS t(prio, city, a, b)
UNION ALL
SELECT concat(CAST(100 + p_partkey % 900 AS STRING), ' Main Street') AS name,
  CAST(49 AS DOUBLE) + CAST(p_partkey % 1800 AS DOUBLE) / CAST(3600 AS DOUBLE) AS lat,
  CAST(-123 AS DOUBLE) - CAST(p_partkey % 1800 AS DOUBLE) / CAST(7200 AS DOUBLE) AS lng,
  CAST((p_partkey * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS importance
FROM {{part}}
UNION ALL
SELECT concat(p_name, ' ', CAST(p_size AS STRING), ' Ave') AS name,
  CAST(49.2 AS DOUBLE) + CAST(p_partkey % 700 AS DOUBLE) / CAST(7000 AS DOUBLE) AS lat,
  CAST(-123 AS DOUBLE) + CAST(p_partkey % 500 AS DOUBLE) / CAST(5000 AS DOUBLE) AS lng,
  CAST((p_partkey * 53) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS importance
FROM {{part}}
"""

VIEWS["posts_fx"] = """
SELECT doc_id AS msgid, CAST(substring(source, 4) AS INT) AS bbs,
  concat('https://bbs.example/topics.php?bbs=', substring(source, 4), '&msgid=', CAST(doc_id AS STRING)) AS source_url,
  concat(CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'Mika Sushi' WHEN 1 THEN 'Retail Sales' WHEN 2 THEN 'Hotel Front Desk'
    WHEN 3 THEN 'Forklift Driver' WHEN 4 THEN 'Carpenter' WHEN 5 THEN 'Janitor' ELSE 'Helper' END, ' wanted ', CAST(doc_id AS STRING)) AS title,
  concat(text, ' $', CAST(15 + doc_id % 10 AS STRING), '-$', CAST(18 + doc_id % 10 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '/hr' ELSE ' per hour' END,
    ' 2024-0', CAST(1 + doc_id % 9 AS STRING), '-', CAST(10 + doc_id % 25 AS STRING), ' or 0', CAST(1 + doc_id % 9 AS STRING), '/1', CAST(doc_id % 10 AS STRING), '/2023',
    CASE CAST(doc_id % 4 AS INT)
      WHEN 0 THEN concat(chr(10), 'Address: ', CAST(100 + doc_id % 900 AS STRING), ' Main Street, ')
      WHEN 1 THEN concat(chr(10), 'Joy Cafe, ', CAST(100 + doc_id % 900 AS STRING), ' Hastings St, ')
      WHEN 2 THEN concat(chr(10), '勤務地：', CAST(100 + doc_id % 900 AS STRING), ' King Ave　', chr(10), 'Yaletown ')
      ELSE ' near ' END,
    CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Vancouver' WHEN 1 THEN 'Kelowna' WHEN 2 THEN 'Langley' WHEN 3 THEN 'Toronto' ELSE 'Nowhere' END) AS body
FROM {documents}
"""

# board pages: three posts per page in different markup, whole document texts
VIEWS["raw_pages_fx"] = """
SELECT concat('https://bbs.example/listing.php?bbs=', substring(source, 4), '&page=', CAST(doc_id AS STRING)) AS url,
  CAST(substring(source, 4) AS INT) AS bbs,
  concat('<html><head><title>Board</title><style>p{margin:0}</style></head><body><h2>Board notices</h2><!-- No.99 --><table>',
    '<tr><td>No.', CAST(doc_id * 10 + 1 AS STRING), '</td><td><h2>Cook wanted ', CAST(doc_id AS STRING), '</h2><p>', text,
    '</p><p>$18-', CAST(20 + doc_id % 9 AS STRING), '/hr 2024-05-17</p><p>Address: ', CAST(100 + doc_id % 1200 AS STRING), ' Main Street, Vancouver</p></td></tr>',
    '<tr><td> no.', CAST(doc_id * 10 + 2 AS STRING), ' new</td><td><h2>Janitor &amp; helper</h2>', chr(10), 'Call No.5 &nbsp;today</td></tr>',
    '<tr><td>No.', CAST(doc_id * 10 + 3 AS STRING), '</td><td><p>', CASE WHEN doc_id % 2 = 0 THEN 'Quiet shop in Toronto looks for a cashier, evenings and weekends' ELSE 'Ask us' END, '</p></td></tr>',
    '<tr><td>No.', CAST(doc_id * 10 + 1 AS STRING), '</td><td>again</td></tr></table>',
    CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('<div class="main-content">', text, ' Kelowna $21</div>')
      WHEN 1 THEN concat('<article>short</article><main>', 'also short', '</main>') ELSE '' END,
    '</body></html>') AS html,
  CAST('2024-06-01 00:00:00' AS TIMESTAMP) AS fetched_at
FROM {documents}
UNION ALL
SELECT concat(url, '&msgid=', CAST(1000000000 + page_id AS STRING)) AS url, CAST(page_id % 20 AS INT) AS bbs,
  html, CAST('2024-06-02 00:00:00' AS TIMESTAMP) AS fetched_at
FROM {pages}
UNION ALL
SELECT concat('https://bbs.example/topics.php?bbs=4&msgid=', CAST(2000000000 + event_id AS STRING)) AS url, CAST(4 AS INT) AS bbs,
  CAST(NULL AS STRING) AS html, CAST('2024-06-03 00:00:00' AS TIMESTAMP) AS fetched_at
FROM {events} WHERE event_type = 'error'
UNION ALL
SELECT concat('https://bbs.example/topics.php?bbs=6&msgid=', CAST(3000000000 + item_id AS STRING)) AS url, CAST(6 AS INT) AS bbs,
  concat('<html><body><table><tr><td>No.', CAST(3100000000 + item_id AS STRING), '</td><td><h2>Baker wanted</h2><p>', text, '</p></td></tr>',
    '<tr><td>Written by Ann, No.', CAST(3000000000 + item_id AS STRING), ' today</td><td><h2>Waiter wanted</h2><p>$19/hr ', text, '</p></td></tr>',
    '<tr><td>[7] No.', CAST(3200000000 + item_id AS STRING), ' 2024</td><td><h2>Driver wanted</h2><p>See No.5 or ', text, '</p></td></tr></table></body></html>') AS html,
  CAST('2024-06-04 00:00:00' AS TIMESTAMP) AS fetched_at
FROM {benchmark}
"""

VIEWS["listings_fx"] = """
SELECT CAST(o_orderkey % 20 AS INT) AS bbs,
  concat('<html><body><a href="topics.php?msgid=', CAST(o_orderkey + 5 AS STRING), '">x</a><a href="listing.php?bbs=4&amp;msgid=',
    CAST(o_orderkey AS STRING), '">y</a><p>No.', CAST(o_custkey AS STRING), '</p><script>No.77</script><b>No.', CAST(o_orderkey + 5 AS STRING),
    '</b></body></html>') AS html,
  o_orderkey AS listing_id
FROM {orders}
"""

VIEWS["crawl_events_fx"] = """
SELECT CAST(floor(CAST(event_id AS DOUBLE) / CAST(3 AS DOUBLE)) AS BIGINT) AS msgid,
  CAST(floor(CAST(event_id AS DOUBLE) / CAST(3 AS DOUBLE)) % 20 AS INT) AS bbs,
  CAST(ts AS TIMESTAMP) AS ingested_at, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok,
  concat(CAST(CAST(ts AS DATE) AS STRING), '/', CAST(user_id AS STRING)) AS run_id
FROM {events}
"""

VIEWS["crawl_log_fx"] = """
SELECT CAST(s_suppkey AS INT) AS bbs, CAST(floor(s_acctbal) AS BIGINT) AS last_seen_msgid
FROM {supplier}
"""

VIEWS["viewports_fx"] = """
SELECT c_custkey AS q_id,
  CAST(-123.3 AS DOUBLE) + CAST(c_custkey % 20 AS DOUBLE) / CAST(40 AS DOUBLE) AS min_lng,
  CAST(49 AS DOUBLE) + CAST(c_custkey % 17 AS DOUBLE) / CAST(40 AS DOUBLE) AS min_lat,
  CAST(-123.3 AS DOUBLE) + CAST(c_custkey % 20 AS DOUBLE) / CAST(40 AS DOUBLE)
    + CASE WHEN c_custkey % 41 = 7 THEN CAST(-1 AS DOUBLE) WHEN c_custkey % 31 = 5 THEN CAST(3 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS max_lng,
  CAST(49 AS DOUBLE) + CAST(c_custkey % 17 AS DOUBLE) / CAST(40 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS max_lat,
  CAST(CASE WHEN c_custkey % 43 = 3 THEN 25 ELSE 8 + c_custkey % 8 END AS INT) AS zoom,
  CASE WHEN c_custkey % 5 = 0 THEN 18 WHEN c_custkey % 47 = 1 THEN -1 ELSE NULL END AS wage_min,
  CASE WHEN c_custkey % 7 = 0 THEN 25 ELSE NULL END AS wage_max,
  CASE WHEN c_custkey % 3 = 0 THEN 'retail' WHEN c_custkey % 3 = 1 THEN '' ELSE NULL END AS category,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 37 = 2 THEN 900 ELSE 100 END AS lim
FROM {customer}
"""

VIEWS["centers_fx"] = """
SELECT c_custkey AS q_id,
  CASE WHEN c_custkey % 41 = 7 THEN CAST(95 AS DOUBLE)
    ELSE CAST(49 AS DOUBLE) + CAST(c_custkey % 19 AS DOUBLE) / CAST(38 AS DOUBLE) END AS lat,
  CAST(-123.3 AS DOUBLE) + CAST(c_custkey % 23 AS DOUBLE) / CAST(40 AS DOUBLE) AS lng,
  CASE WHEN c_custkey % 29 = 4 THEN CAST(70 AS DOUBLE) WHEN c_custkey % 31 = 5 THEN CAST(50 AS DOUBLE)
    ELSE CAST(1 + c_custkey % 10 AS DOUBLE) END AS radius_km,
  CASE WHEN c_custkey % 5 = 0 THEN 18 ELSE NULL END AS wage_min,
  CASE WHEN c_custkey % 7 = 0 THEN 25 ELSE NULL END AS wage_max,
  CASE WHEN c_custkey % 3 = 0 THEN 'retail' ELSE '' END AS category,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 37 = 2 THEN 0 ELSE 100 END AS lim
FROM {customer}
"""

VIEWS["regions_fx"] = """
SELECT CAST(s_suppkey + 1 AS INT) AS id,
  CASE CAST(s_nationkey % 4 AS INT) WHEN 0 THEN 'Vancouver' WHEN 1 THEN 'Victoria' WHEN 2 THEN 'Toronto' ELSE 'Whistler' END AS city,
  CAST(s_suppkey % 50 AS INT) AS bbs,
  concat(CASE CAST(s_nationkey % 3 AS INT) WHEN 0 THEN 'https://bbs.example' WHEN 1 THEN 'https://old.example' ELSE 'https://www.old.example' END,
    '/listing.php?bbs=', CAST(s_suppkey % 50 AS STRING)) AS listing_url,
  CAST(49 AS DOUBLE) AS center_lat, CAST(-123 AS DOUBLE) AS center_lng
FROM {supplier}
"""

VIEWS["terms_fx"] = """
SELECT c_custkey AS q_id,
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(CAST(100 + c_custkey % 900 AS STRING), ' Ma') WHEN 1 THEN 'Van'
    WHEN 2 THEN 'main ' WHEN 3 THEN lower(substring(c_mktsegment, 1, 2)) ELSE concat('widget ', CAST(c_custkey % 50 AS STRING)) END AS term
FROM {customer}
"""

VIEWS["favorites_fx"] = "SELECT o_custkey AS user_id, o_orderkey AS job_id FROM {orders}"

VIEWS["corrections_fx"] = """
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'P' THEN 'approved' WHEN 'F' THEN 'hold' ELSE 'pending' END AS status,
  o_orderpriority AS reason,
  CAST(49 AS DOUBLE) + CAST(o_custkey % 1000 AS DOUBLE) / CAST(2000 AS DOUBLE) AS suggested_lat,
  CAST(-123 AS DOUBLE) - CAST(o_custkey % 1000 AS DOUBLE) / CAST(4000 AS DOUBLE) AS suggested_lng
FROM {orders}
"""

VIEWS["blocklist_fx"] = """
SELECT concat('https://bbs.example/topics.php?bbs=', CAST(o_orderkey % 20 AS STRING), '&msgid=', CAST(o_orderkey AS STRING)) AS source_url,
  CAST(NULL AS STRING) AS host
FROM {orders} WHERE o_orderstatus = 'P'
UNION ALL
SELECT CAST(NULL AS STRING) AS source_url, concat('host', CAST(s_suppkey AS STRING), '.example') AS host FROM {supplier}
"""


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix a statement with the derived tables it names."""
    order: list[str] = []

    def visit(text: str):
        for v in _needs(text):
            if v not in order:
                visit(VIEWS[v])
                order.append(v)

    visit(sql)
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in order]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def for_duckdb(sql: str) -> str:
    out = with_views(sql)
    for t in BASE:
        out = out.replace("{" + t + "}", t)
    return out


def for_spark(sql: str, sf_dir: str) -> str:
    out = with_views(sql)
    for t in BASE:
        out = out.replace("{" + t + "}", f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`")
    return out


def view(spark, sf_dir: str, name: str):
    """A derived table as DataFrame."""
    return spark.sql(for_spark(f"SELECT * FROM {name}", sf_dir))
