"""DuckDB SQL for the queries that SQL can express."""

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
grams AS (SELECT doc_id, n, md5(unnest(s)) AS g FROM sized),
held AS (SELECT * FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)),
possible AS (SELECT * FROM held WHERE doc_id IN (SELECT doc_id FROM held GROUP BY doc_id HAVING 100 * count(*) >= 80 * min(n))),
pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM possible p JOIN possible q ON p.g = q.g AND p.doc_id < q.doc_id
  GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 80 * (min(p.n) + min(q.n) - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS doc_id, a AS low FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(r.low, s.doc_id) AS component_id
FROM sized s LEFT JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id) r USING (doc_id)
"""

# The checksum is taken byte by byte from a table that SQL makes from the polynomial.
SPELLING = rf"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
told AS (
  SELECT DISTINCT run, doc_id, xor(list_reduce(
    list_transform(range(1, 1 + strlen(k)), lambda i: CAST(('0x' || substr(hex(encode(k)), 2 * i - 1, 2)) AS BIGINT)),
    lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]), 4294967295), 4294967295) AS h
  FROM (SELECT DISTINCT run, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs WHERE length(run) >= 7), crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM runs JOIN told USING (run, doc_id)),
vocab AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
holes AS (
  SELECT DISTINCT word, n, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, v.word, v.n FROM holes h JOIN vocab v ON v.word = h.rest
  UNION SELECT v.word, h.word, h.n FROM holes h JOIN vocab v ON v.word = h.rest),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word),
judged AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * v.n THEN b.other END AS form, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n
  FROM vocab v LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, form AS at FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.at WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN judged j ON j.word = c.at WHERE j.form IS NULL)
SELECT word, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, coalesce(root, word) AS root
FROM judged LEFT JOIN ends USING (word)
"""

NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) <= 10
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_ngram_jaccard": JACCARD, "op11_spelling_variants": SPELLING, "op13_hard_negatives": NEGATIVES}
