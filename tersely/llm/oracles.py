"""SQL equivalents of the operators' queries that SQL can express."""

from __future__ import annotations

UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
INDEX_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED_WORD = r"'[^\x20\x09-\x0D]+'"

def _hashed(*columns: str) -> str:
    items = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"sha256({' || '.join(items)})"


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i:
        CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT)),
    lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384)
      ELSE xor(a, x) // 2 END))"""


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (g, pos, n, h), by repeated pairing."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2, n)"""


def _fold(name: str, start: str, tree: str) -> str:
    """Digests on the way from each row of ``start`` (rid, g, pos, n, h) up to the root of ``tree``."""
    return f"""{name} AS (
  SELECT rid, g, 0 AS lvl, pos, n, h FROM {start}
  UNION ALL
  SELECT f.rid, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END)
  FROM {name} f LEFT JOIN {tree} s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1::BIGINT)
  WHERE f.n > 1)"""


MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'n') AS g,
    {_hashed('doc_id', 'source', 'lang', 'n_chars', 'text')} AS h,
    CASE WHEN {CRC32} % 7 = 0
      THEN {_hashed('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n
  FROM rows),
{_tree('tree', 'leaves')},
subroots AS (
  SELECT g AS part, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, h
  FROM tree WHERE n = 1),
{_tree('top', 'subroots')},
{_fold('climb', "(SELECT rid, g, pos, n, coalesce(changed, h) AS h FROM leaves)", 'tree')},
climbed AS (
  SELECT c.rid, '' AS g, s.pos, s.n, c.h FROM climb c JOIN subroots s ON s.part = c.g WHERE c.n = 1),
{_fold('last_climb', 'climbed', 'top')},
siblings AS (
  SELECT l.rid, 0 AS scope, t.lvl, t.h FROM leaves l JOIN tree t
    ON t.g = l.g AND t.n > 1 AND t.pos = xor(l.pos >> t.lvl, 1::BIGINT)
  UNION ALL
  SELECT l.rid, 1, t.lvl, t.h FROM leaves l JOIN subroots s ON s.part = l.g JOIN top t
    ON t.n > 1 AND t.pos = xor(s.pos >> t.lvl, 1::BIGINT)),
proofs AS (SELECT rid, string_agg(h, '' ORDER BY scope, lvl) AS proof FROM siblings GROUP BY rid)
SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, root.h AS root, folded.h AS folded_root,
  sha256(coalesce(proof, '')) AS proof_sha256, folded.h = root.h AS verified
FROM leaves JOIN subroots ON subroots.part = leaves.g
  JOIN (SELECT rid, h FROM last_climb WHERE n = 1) folded ON folded.rid = leaves.rid
  LEFT JOIN proofs ON proofs.rid = leaves.rid,
  (SELECT h FROM top WHERE n = 1) root
"""

URLS = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_TO_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND place = 1
"""

CONTAMINATION = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, {UPPER_TO_LOWER}), {INDEX_WORD}) AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
    array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i)
  WHERE len(w) > 0),
docs AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), {INDEX_WORD}) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
windows AS (
  SELECT doc_id, i AS place, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (
  SELECT doc_id, place, size, item_id FROM windows JOIN item_windows USING (size, words)),
covered AS (
  SELECT doc_id, count(DISTINCT place + k) AS n_hit
  FROM hits, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUBSTRINGS = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED_WORD}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS words
  FROM docs, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 20)) AS t(k)),
left_over AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(i)) AS words
  ANTI JOIN gone USING (doc_id, i)
  GROUP BY words.doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors AS q JOIN vectors AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id, score
FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

CHAT = """
WITH turns AS (
  SELECT conv_id, floor(turn / 256)::BIGINT AS block, coalesce(role, 'unknown') AS role,
    coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id, floor(turn / 256)
      ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations),
seen AS (
  SELECT turns.*, speaker, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' ELSE '<|user|> ' || role END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM turns JOIN (SELECT DISTINCT conv_id, role AS speaker FROM turns) AS speakers USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, block, speaker ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM seen)
SELECT conv_id, block, speaker, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(start::BIGINT || ':' || (start + length(body))::BIGINT, ',' ORDER BY place)
    FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, block, speaker
"""

NEAR_COPIES = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER_TO_LOWER}), {SPACED_WORD}) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i)
  WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id,
  docs.doc_id = component_id AS kept
FROM docs JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLES = {
    "op1_url_rules": URLS,
    "op2_decontaminate": CONTAMINATION,
    "op3_substrings": SUBSTRINGS,
    "op4_top_k": TOP_K,
    "op6_chat": CHAT,
    "op8_near_copies": NEAR_COPIES,
    "op11_merkle": MERKLE,
}
