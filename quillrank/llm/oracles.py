"""DuckDB SQL for the contract queries that SQL can express."""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""


def _shingles(n: int) -> str:
    return f"""CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END"""


NEAR_DEDUP = f"""
WITH RECURSIVE sets AS (
  SELECT doc_id, {_shingles(4)} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), least AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = u
"""

DECONTAMINATION = f"""
WITH sets AS (
  SELECT doc_id, {_shingles(5)} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), item_sets AS (
  SELECT item_id, {_shingles(5)} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
), words AS (
  SELECT DISTINCT doc_id, unnest(s) AS x FROM sets
), items AS (
  SELECT item_id, len(s) AS n, unnest(s) AS x FROM item_sets
)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM words JOIN items USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
