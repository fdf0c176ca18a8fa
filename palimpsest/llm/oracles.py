"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

OP2 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT row, doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, array_to_string(w[i:i + 12], ' ') AS win
  FROM words, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
), firsts AS (SELECT h, win, min(doc_id) AS first FROM wins GROUP BY h, win HAVING count(*) > 1),
hits AS (SELECT row, i FROM wins JOIN firsts USING (h, win) WHERE first < doc_id),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS p FROM hits),
lists AS (SELECT row, list(p) AS ps FROM gone GROUP BY row),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) a
  ANTI JOIN gone g USING (row, p) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (row) LEFT JOIN kept USING (row)
"""

OP6 = """
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), folded AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 23)::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars FROM folded
"""

OP7 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (SELECT row, d.n AS n, i, item_id FROM doc_windows d JOIN item_windows USING (n, win)),
marked AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (row) LEFT JOIN named USING (row)
"""

OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id),
shared AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
inter AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM (SELECT * FROM grams SEMI JOIN shared USING (g)) x JOIN (SELECT * FROM grams SEMI JOIN shared USING (g)) y USING (g)
  WHERE x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM inter JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sizes
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots ON node = d.doc_id
"""

_CRLF = "chr(13) || chr(10)"
_SIDES = r"""
WITH RECURSIVE pages_found AS (
  SELECT page_id::BIGINT AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CASE WHEN starts_with(sha256(coalesce(html, '')), '00') THEN substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS damaged
  FROM pages
), blocks AS (
  SELECT 0 AS side, page_id, url, sha256(html) AS written, strlen(html) AS size, sha256(html) AS found, strlen(html) AS found_size FROM pages_found
  UNION ALL SELECT 1, page_id, url, sha256(html), strlen(html), sha256(damaged), strlen(damaged) FROM pages_found
), named AS (
  SELECT *, md5(concat_ws('|', coalesce(page_id::VARCHAR, ''), url, written, row_number() OVER (PARTITION BY side, page_id, url, written, found)::VARCHAR)) AS record_id FROM blocks
), topped AS (
  SELECT *, 'WARC/1.1' || NL || 'WARC-Type: resource' || NL || 'WARC-Record-ID: <urn:uuid:' || record_id[1:8] || '-' || record_id[9:12] || '-' || record_id[13:16] || '-' || record_id[17:20] || '-' || record_id[21:32] || '>' || NL
    || 'WARC-Date: 2020-01-01T00:00:00Z' || NL || 'WARC-Target-URI: ' || url || NL || 'WARC-Block-Digest: sha256:' || written || NL || 'Content-Type: text/html' || NL || 'Content-Length: ' || size::VARCHAR || NL || NL AS top
  FROM named
), held AS (
  SELECT side, page_id, record_id, (('0x' || record_id[25:32])::BIGINT % (SELECT greatest(16, ceil(sum(found_size) / 268435456))::BIGINT FROM blocks b WHERE b.side = topped.side))::INT AS file,
    (strlen(top) + found_size + 4)::BIGINT AS length, sha256(top || found) AS digest
  FROM topped
), kept AS (
  SELECT * FROM held WHERE side = 0 OR NOT starts_with(digest, '01')
  UNION ALL SELECT * FROM held WHERE side = 1 AND starts_with(digest, '02')
), placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY side, file ORDER BY record_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    row_number() OVER (PARTITION BY side, file, record_id ORDER BY digest) AS nth, printf('%05x', file) || record_id[1:2] AS path
  FROM kept
), level7 AS (
  SELECT side, path, sha256(string_agg(record_id || ' ' || digest || ' ' || length::VARCHAR, chr(10) ORDER BY record_id, digest)) AS digest, sum(length)::BIGINT AS bytes FROM placed GROUP BY side, path
)""".replace("NL", _CRLF)
#: The tree from slots to the root, and the way down from the root to slots that differ.
_UP = "".join(
    f", level{n} AS (SELECT side, path[1:{n}] AS path, sha256(string_agg(level{n + 1}.path || ' ' || digest || ' ' || bytes::VARCHAR, chr(10) ORDER BY level{n + 1}.path)) AS digest, sum(bytes)::BIGINT AS bytes FROM level{n + 1} GROUP BY side, level{n + 1}.path[1:{n}])"
    for n in range(6, -1, -1)
)
_DOWN = "".join(
    f", differing{n} AS (SELECT path FROM level{n} WHERE {'true' if n == 0 else f'path[1:{n - 1}] IN (SELECT path FROM differing{n - 1})'} GROUP BY path HAVING count(*) < 2 OR min(digest) <> max(digest) OR min(bytes) <> max(bytes))"
    for n in range(8)
)
OP9 = (
    _SIDES
    + _UP
    + _DOWN
    + """
SELECT coalesce(a.page_id, b.page_id) AS page_id, record_id, file, a."offset" AS "offset", a.length AS length, b."offset" AS replica_offset, b.length AS replica_length, a.digest AS digest,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.path IN (SELECT path FROM differing7) AND a.digest <> b.digest THEN 'damaged' ELSE 'intact' END AS status
FROM (SELECT * FROM placed WHERE side = 0) a FULL JOIN (SELECT * FROM placed WHERE side = 1) b USING (file, record_id, nth)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2, "op6_chat_formatting": OP6, "op7_decontamination": OP7, "op8_jaccard_join": OP8, "op9_warc_fixity": OP9}
