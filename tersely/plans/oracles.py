"""SQL equivalents of the registered queries, over the same tables."""

from __future__ import annotations


def _tokens(text: str) -> str:
    return f"CAST(ceil(length({text}) / 4.0) AS BIGINT)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- shared derivations -----------------------------------------------------------

LOG_LINES = """log_lines AS (
  SELECT user_id, event_id, ts, event_type,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z '
      || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
         WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END
      || ' ' || event_type AS line
  FROM events)"""

RUNS = """marked AS (
  SELECT *, regexp_replace(line, '^[^ ]* ', '') AS norm FROM log_lines),
starts AS (
  SELECT *, CASE WHEN lag(norm) OVER w = norm THEN 0 ELSE 1 END AS new_run
  FROM marked WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(new_run) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM starts),
runs AS (
  SELECT user_id, run, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id,
    arg_min(line, event_id) AS first_line, arg_max(line, event_id) AS last_line,
    min(norm) AS norm, sum(length(line) + 1) AS chars
  FROM numbered GROUP BY user_id, run)"""

RUN_LINES = """
SELECT user_id, first_id AS event_id, n,
  CASE WHEN n >= 3 THEN '[×' || n || '] ' || norm ELSE first_line END AS line FROM runs
UNION ALL
SELECT user_id, last_id AS event_id, n, last_line AS line FROM runs WHERE n = 2"""

LINES = """doc_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""

ENV = r"""(\b(?:export\s+)?)([A-Z][A-Z0-9_]{1,63})\s*=\s*("[^"]*"|''[^'']*''|[^\s]+)"""

ORDER_LISTS = """order_lists AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 3 AS form, o_orderstatus AS st, o_orderpriority AS pr
  FROM orders)"""

# The third record of form 2 repeats "status": its last value stands at the first one's place.
ORDER_FORMS = r"""order_forms AS (
  SELECT doc_id, CASE WHEN form = 0 THEN
    'data[3]{id,status,prio}:' || chr(10)
    || array_to_string(['  ' || (doc_id * 10 + i) || ',' || st || ',' || pr || chr(10) for i in [0, 1, 2]], '')
  ELSE 'data[3]:' || chr(10)
    || array_to_string([E'  -\n    id: ' || (doc_id * 10 + i) || E'\n    status: ' || st
         || E'\n    prio: ' || pr || chr(10) for i in [0, 1]], '')
    || CASE WHEN form = 1 THEN E'  -\n    status: F\n'
       ELSE E'  -\n    id: 7\n    status:\n      b[0]:\n    prio: null\n' END
  END AS compact,
  '[' || array_to_string(['{"id":' || (doc_id * 10 + i) || ', "status":"' || st || '","prio" : "' || pr || '"}'
      for i in (CASE WHEN form = 0 THEN [0, 1, 2] ELSE [0, 1] END)], ',')
    || CASE form WHEN 1 THEN ',{"status":"F"}'
       WHEN 2 THEN ',{"id":7,"status":{"a":[1]},"prio":null,"status":{"b":[]}}' ELSE '' END
    || ']' AS text
  FROM order_lists)"""

RESULTS = f"""sized AS (
  SELECT d.doc_id, d.lang, d.source, d.text, e.ts,
    {_tokens('d.text')} AS input_tokens,
    {_tokens("CASE WHEN d.doc_id % 2 = 0 THEN replace(d.text, chr(10), '') ELSE d.text END")}
      AS output_tokens,
    CASE WHEN d.source = 'src3' THEN 'unknown' ELSE d.source END AS tool
  FROM documents d JOIN events e ON e.event_id = d.doc_id),
results AS (
  SELECT *, output_tokens < input_tokens AS transformed,
    CASE WHEN output_tokens < input_tokens THEN 'ok'
      WHEN doc_id % 2 = 0 THEN 'rewrite did not reduce estimated tokens'
      ELSE 'input exceeds max_input_bytes' END AS reason
  FROM sized)"""

COUNTERS = """count(*) AS attempted,
  count(*) FILTER (WHERE transformed) AS applied,
  count(*) FILTER (WHERE NOT transformed) AS pass_through,
  CAST(sum(CASE WHEN transformed THEN input_tokens - output_tokens ELSE 0 END) AS BIGINT)
    AS tokens_saved"""

PROMPTS = """parts AS (
  SELECT conv_id || '-' || turn AS doc_id, turn, role, text AS t, (conv_id + turn) % 6 AS form,
    array_to_string(['{"id":' || i || ',"role":"' || role || '"}'
      for i in range(0, turn + 2)], ',') AS objects,
    array_to_string(['2024-01-01T00:00:0' || (i % 10) || 'Z ERROR ' || role || ' timeout' || chr(10)
      for i in range(0, turn + 3)], '') AS logs,
    array_to_string(['  - id: ' || i || chr(10) || '    role: ' || role || chr(10)
      for i in range(0, turn + 2)], '') AS records,
    array_to_string(['    ' || i || ',' || role || chr(10)
      for i in range(0, turn + 2)], '') AS cells4,
    array_to_string(['  ' || i || ',' || role || chr(10)
      for i in range(0, turn + 2)], '') AS cells2,
    array_to_string(['  File "m' || i || '.py", line ' || i || ', in f' || chr(10)
      for i in range(0, turn + 7)], '') AS frames
  FROM conversations),
prompts AS (
  SELECT *, t || CASE form
    WHEN 0 THEN E'\\n\\n```json\\n[' || objects || E']\\n```\\nWhat is wrong?\\n'
    WHEN 1 THEN E'\\n\\n```log\\n' || logs || E'```\\n'
    WHEN 2 THEN E'\\n\\n```python\\nprint(1)\\n```\\nWhy?\\nSay it in short.\\n'
    WHEN 4 THEN E'\\n\\n```yaml\\nservice: checkout\\nitems:\\n' || records || E'```\\n'
    WHEN 5 THEN E'\\n\\n```\\nTraceback (most recent call last):\\n' || frames
      || E'ValueError: bad\\n```\\n'
    ELSE '' END AS text
  FROM parts),
lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM prompts),
kinds AS (
  SELECT *, CASE
    WHEN (contains(text, 'Traceback') OR regexp_matches(text, '\\bat [^\\n]*:\\d+'))
      AND len(ls) >= 2 THEN 'stacktrace'
    WHEN len(ls) >= 2
      AND (contains(ls[1], ',') OR contains(ls[1], chr(9)))
      AND (contains(ls[2], ',') OR contains(ls[2], chr(9)))
      AND len(list_distinct(list_transform(ls, lambda x: length(x) - length(replace(x, ',', ''))))) = 1
      THEN 'table'
    WHEN form = 1 THEN 'log'
    ELSE 'plain' END AS whole,
    trim(text, chr(10) || chr(9) || ' ') AS trimmed
  FROM lined)"""

# Segments of the derived prompts, from how they were put together.
SEGMENTS = """segs AS (
  SELECT doc_id, 1 AS seg_no, whole AS kind, 'whole' AS source, trimmed AS text,
    CASE whole WHEN 'stacktrace' THEN 0.75 WHEN 'log' THEN 0.8 ELSE 0.7 END AS confidence
  FROM kinds WHERE whole <> 'plain'
  UNION ALL
  SELECT doc_id, 1, 'plain', 'plain', t || chr(10) || chr(10), 1.0
  FROM kinds WHERE whole = 'plain' AND form IN (0, 2, 4)
  UNION ALL
  SELECT doc_id, 2, CASE form WHEN 0 THEN 'json' WHEN 4 THEN 'yaml' ELSE 'plain' END,
    CASE form WHEN 0 THEN 'fenced-json' WHEN 4 THEN 'fenced-yaml' ELSE 'fenced-python' END,
    CASE form WHEN 0 THEN '[' || objects || ']' || chr(10)
      WHEN 4 THEN E'service: checkout\\nitems:\\n' || records ELSE E'print(1)\\n' END,
    CASE form WHEN 0 THEN 0.99 WHEN 4 THEN 0.9 ELSE 1.0 END
  FROM kinds WHERE whole = 'plain' AND form IN (0, 2, 4)
  UNION ALL
  SELECT doc_id, 3, 'plain', CASE form WHEN 2 THEN 'mixed-tail' ELSE 'plain' END,
    CASE form WHEN 0 THEN E'\\nWhat is wrong?\\n' WHEN 2 THEN E'\\nWhy?\\nSay it in short.\\n'
      ELSE E'\\n' END, 1.0
  FROM kinds WHERE whole = 'plain' AND form IN (0, 2, 4)
  UNION ALL
  SELECT doc_id, 1, 'plain', CASE WHEN contains(trimmed, chr(10)) THEN 'mixed-tail' ELSE 'plain' END,
    text, 1.0
  FROM kinds WHERE whole = 'plain' AND form = 3)"""

SCORED = """scored AS (
  SELECT s.*, CASE s.kind
      WHEN 'json' THEN least(0.95, 0.5 + 0.03 * greatest(0, p.turn + 1))
      WHEN 'yaml' THEN 0.6
      WHEN 'log' THEN least(0.9, 0.3 + 0.05 * (
        SELECT count(*) FROM (SELECT 1 FROM (SELECT unnest(p.ls) AS l)
          GROUP BY regexp_replace(trim(l), '[0-9]', '0', 'g') HAVING count(*) >= 3)))
      WHEN 'stacktrace' THEN CASE WHEN len(list_filter(p.ls, lambda x:
        starts_with(trim(x), 'File ') OR starts_with(trim(x), 'at '))) < 6 THEN 0.4 ELSE 0.75 END
      WHEN 'plain' THEN 0.05 ELSE 0.2 END AS score
  FROM segs s JOIN kinds p USING (doc_id))"""

# Rewritten text of a log prompt and of a trace prompt.
REWRITES = f"""log_marked AS (
  SELECT doc_id, i, l, trim(regexp_replace(l, '^[0-9]{{4}}-[0-9-]+T[0-9:]+Z\\s*', '')) AS norm
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM kinds
        WHERE whole = 'log')),
log_runs AS (
  SELECT *, sum(new_run) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY doc_id ORDER BY i) = norm THEN 0 ELSE 1 END
      AS new_run FROM log_marked)),
log_texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY run) || chr(10) AS rewritten FROM (
    SELECT doc_id, run, CASE WHEN count(*) >= 3 THEN '[×' || count(*) || '] ' || min(norm)
      ELSE string_agg(l, chr(10) ORDER BY i) END AS line
    FROM log_runs GROUP BY doc_id, run)
  GROUP BY doc_id),
elided_texts AS (
  SELECT doc_id, trimmed, ls, array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''), chr(10))
    || E'\\n```\\nTraceback (most recent call last):\\n'
    || array_to_string(['  File "m' || i || '.py", line ' || i || ', in f' for i in range(0, 3)], chr(10))
    || chr(10) || '[... ' || (turn + 1) || ' frames omitted ...]' || chr(10)
    || array_to_string(['  File "m' || i || '.py", line ' || i || ', in f'
         for i in range(turn + 4, turn + 7)], chr(10))
    || E'\\nValueError: bad\\n```\\n' AS rewritten
  FROM kinds WHERE whole = 'stacktrace'),
trace_texts AS (
  SELECT doc_id, ceil(length(rewritten) / 4.0) < ceil(length(trimmed) / 4.0) AS elided,
    CASE WHEN ceil(length(rewritten) / 4.0) < ceil(length(trimmed) / 4.0) THEN rewritten
      ELSE 'trace:' || chr(10) || '  stack[' || len(ls) || ']:' || chr(10)
        || array_to_string(['    - ' || rtrim(x) || chr(10) for x in ls], '') END AS rewritten
  FROM elided_texts),
seg_texts AS (
  SELECT s.*, CASE
      WHEN s.kind = 'json' THEN 'data[' || (p.turn + 2) || ']{{id,role}}:' || chr(10) || p.cells2
      WHEN s.kind = 'yaml' THEN E'data:\\n  service: checkout\\n  items[' || (p.turn + 2)
        || ']{{id,role}}:' || chr(10) || p.cells4
      WHEN s.kind = 'log' THEN l.rewritten
      WHEN s.kind = 'stacktrace' THEN r.rewritten END AS rewritten, r.elided
  FROM segs s JOIN kinds p USING (doc_id) LEFT JOIN log_texts l USING (doc_id)
    LEFT JOIN trace_texts r USING (doc_id)),
joined AS (
  SELECT doc_id, string_agg(coalesce(rewritten, text), '' ORDER BY seg_no) AS joined,
    bool_or(rewritten IS NOT NULL) AS changed
  FROM seg_texts GROUP BY doc_id),
compacted AS (
  SELECT j.doc_id, p.text, j.joined, j.changed,
    {_tokens('p.text')} AS input_tokens, {_tokens('j.joined')} AS joined_tokens,
    j.changed AND {_tokens('j.joined')} >= {_tokens('p.text')} AS revert
  FROM joined j JOIN prompts p USING (doc_id))"""

COMPACTED = """
SELECT doc_id, CASE WHEN revert THEN text ELSE joined END AS output,
  changed AND NOT revert AND joined <> text AS transformed,
  CASE WHEN changed AND NOT revert THEN 'transformed' ELSE 'pass-through' END AS action,
  CASE WHEN revert THEN 'rewrite did not reduce estimated tokens' ELSE 'ok' END AS reason,
  input_tokens, CASE WHEN revert THEN input_tokens ELSE joined_tokens END AS output_tokens
FROM compacted"""

PROPS = """props_docs AS (
  SELECT event_id AS doc_id, event_type, props, event_type = 'error' AS listed,
    CASE WHEN event_type = 'error' THEN '{"list":[{"kind":"error","n":1},{"kind":"error","n":1},{"kind":"error","n":1}]}'
      ELSE props END AS text,
    CASE WHEN event_type = 'error' THEN E'data:\\n  list[3]{kind,n}:\\n    error,1\\n    error,1\\n    error,1\\n'
      ELSE props END AS output
  FROM events)"""

TRACES = """trace_docs AS (
  SELECT event_id AS doc_id, 3 + event_id % 12 AS n, event_type,
    CASE WHEN event_id % 3 = 0 THEN E'\\n    call()' ELSE '' END AS code,
    event_id % 3 = 0 AS coded
  FROM events)"""


def _frames(first: str, after: str) -> str:
    return (
        f"['  File \"m' || i || '.py\", line ' || i || ', in f' || code "
        f"for i in range({first}, {after})]"
    )


DELIMITED = """delim AS (
  SELECT o_orderkey AS k, o_orderkey % 3 AS form, o_orderstatus AS st, o_orderpriority AS pr
  FROM orders)"""

ORACLES: dict[str, str] = {
    # --- logs ---
    "log_run_collapse": _with(LOG_LINES, RUNS) + RUN_LINES,
    "log_run_savings_by_user": _with(LOG_LINES, RUNS)
    + f""", sums AS (
  SELECT user_id, CAST(sum(n) AS BIGINT) AS lines_in,
    CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE n END) AS BIGINT) AS lines_out,
    count(*) FILTER (WHERE n >= 3) AS runs_collapsed,
    sum(chars) AS chars_in,
    sum(CASE WHEN n >= 3 THEN length('[×' || n || '] ' || norm) + 1 ELSE chars END) AS chars_out
  FROM runs GROUP BY user_id)
SELECT user_id, lines_in, lines_out, runs_collapsed,
  CAST(ceil(chars_in / 4.0) AS BIGINT) AS tokens_in,
  CAST(ceil(chars_out / 4.0) AS BIGINT) AS tokens_out,
  CAST(ceil(chars_in / 4.0) AS BIGINT) - CAST(ceil(chars_out / 4.0) AS BIGINT) AS tokens_saved
FROM sums""",
    "log_line_fields": _with(LOG_LINES)
    + """SELECT event_id,
  CASE WHEN event_type <> 'view' THEN split_part(line, ' ', 1) END AS ts,
  CASE WHEN event_type <> 'view' THEN split_part(line, ' ', 2) END AS level,
  CASE WHEN event_type <> 'view' THEN split_part(line, ' ', 3) END AS msg,
  CASE WHEN event_type = 'view' THEN 'node ' || line END AS line
FROM log_lines""",
    "log_repeated_lines": _with(LOG_LINES)
    + """SELECT user_id, count(*) FILTER (WHERE n >= 3) AS repeated FROM (
  SELECT user_id, regexp_replace(line, '[0-9]', '0', 'g') AS masked, count(*) AS n
  FROM log_lines GROUP BY ALL) GROUP BY user_id""",
    # --- tokens and scalar text ---
    "token_estimate_docs": f"""SELECT doc_id, {_tokens('text')} AS tokens,
  CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""",
    "token_budget_violations": f"""SELECT doc_id, {_tokens('text')} AS tokens
FROM documents WHERE {_tokens('text')} > 1000""",
    "token_totals_by_lang": _with(RESULTS)
    + """SELECT lang, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(CAST(sum(output_tokens) - sum(input_tokens) AS DOUBLE) / sum(input_tokens) * 100.0, 2)
    AS delta_pct
FROM results GROUP BY lang""",
    "compression_ratio_docs": _with(RESULTS)
    + """SELECT doc_id, input_tokens, output_tokens,
  CASE WHEN input_tokens = 0 THEN 0.0
    ELSE CAST(output_tokens - input_tokens AS DOUBLE) / input_tokens END AS ratio
FROM results""",
    "token_budget_by_conversation": f"""WITH joined AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, {_tokens('text')} AS tokens, {_tokens('text')} > 700 AS over FROM joined""",
    "repeated_lines_docs": _with(LINES)
    + """, masked AS (
  SELECT doc_id, regexp_replace(trim(line), '[0-9]', '0', 'g') AS m, count(*) AS n
  FROM doc_lines GROUP BY ALL)
SELECT doc_id, count(*) FILTER (WHERE m <> '' AND n >= 3) AS repeated FROM masked GROUP BY doc_id""",
    "chunk_documents": r"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}\z|.{1,499}\n|.{1,500}') AS found FROM documents)
SELECT doc_id, generate_subscripts(found, 1) - 1 AS chunk_no, unnest(found) AS chunk FROM cut""",
    "redact_and_hash": """WITH env AS (
  SELECT event_id, 'export API_KEY=' || user_id || ' MODE=''' || event_type || ''' x=1' AS text,
    'export API_KEY=*** MODE=*** x=1' AS redacted FROM events)
SELECT event_id, redacted, 'sha256:' || sha256(redacted) AS input_hash FROM env""",
    "redact_documents": rf"""SELECT doc_id,
  'sha256:' || sha256(regexp_replace(text, '{ENV}', '\1\2=***', 'g')) AS input_hash,
  sha256(regexp_replace(text,
    '(\b(?:export\s+)?)(token|password|secret)\s*=\s*("[^"]*"|''[^'']*''|[^\s]+)', '\1\2=***', 'g'))
    AS by_key
FROM documents""",
    "unicode_trim_lines": """SELECT doc_id, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS trimmed,
  len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS filled
FROM documents""",
    # --- records and JSON ---
    "pack_orders_by_customer": """SELECT o_custkey, 0::BIGINT AS block_no, count(*) AS n,
  'orders[' || count(*) || ']{id,status,prio}:' || chr(10)
  || string_agg('  ' || o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority, chr(10)
       ORDER BY o_orderdate, o_orderkey) || chr(10) AS block
FROM orders GROUP BY o_custkey""",
    "pack_events_by_user": r"""SELECT user_id, 0::BIGINT AS block_no, count(*) AS n,
  'events[' || count(*) || ']{event_id,what,seen}:' || chr(10)
  || string_agg('  ' || event_id || ',' || event_type || '\, \\' || replace(props, ',', '\,') || ','
       || CASE WHEN event_type = 'view' THEN 'null' ELSE event_type END, chr(10)
       ORDER BY ts, event_id) || chr(10) AS block
FROM events GROUP BY user_id""",
    "pack_orders_in_blocks": """WITH numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS block_no
  FROM orders)
SELECT o_orderstatus, block_no, count(*) AS n,
  'orders[' || count(*) || ']{id,prio}:' || chr(10)
    || string_agg('  ' || o_orderkey || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10)
    AS block
FROM numbered GROUP BY o_orderstatus, block_no""",
    "pack_lineitem_lines": """SELECT l_orderkey, 0 AS part, NULL::INTEGER AS l_linenumber,
  NULL::BIGINT AS l_partkey,
  'items[' || count(*) || ']{l_linenumber,l_partkey,l_returnflag,l_linestatus}:' AS line
FROM lineitem GROUP BY l_orderkey
UNION ALL
SELECT l_orderkey, 1, l_linenumber, l_partkey,
  '  ' || l_linenumber || ',' || l_partkey || ',' || l_returnflag || ',' || l_linestatus FROM lineitem""",
    "homogeneous_record_test": "SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS records FROM orders",
    "json_predicate": """SELECT event_id, json_valid(props) AS whole, json_valid(props || ' x') AS garbage,
  json_valid(CAST(event_id AS VARCHAR)) AS scalar, json_valid(event_type) AS word FROM events""",
    "json_node_rows": _with(ORDER_LISTS)
    + """, items AS (SELECT *, unnest([0, 1, 2]) AS i FROM order_lists),
full_items AS (SELECT * FROM items WHERE i < 2 OR form = 0)
SELECT doc_id, 0::BIGINT AS depth, NULL AS key, 'array' AS kind, NULL AS value, 3::BIGINT AS children
FROM order_lists
UNION ALL SELECT doc_id, 1, NULL, 'object', NULL,
  CASE WHEN i = 2 AND form = 1 THEN 1 ELSE 3 END FROM items
UNION ALL SELECT doc_id, 2, 'id', 'number', CAST(doc_id * 10 + i AS VARCHAR), NULL FROM full_items
UNION ALL SELECT doc_id, 2, 'status', 'string', st, NULL FROM full_items
UNION ALL SELECT doc_id, 2, 'prio', 'string', pr, NULL FROM full_items
UNION ALL SELECT doc_id, 2, 'status', 'string', 'F', NULL FROM items WHERE i = 2 AND form = 1
UNION ALL SELECT doc_id, 2, 'id', 'number', '7', NULL FROM items WHERE i = 2 AND form = 2
UNION ALL SELECT doc_id, 2, 'status', 'object', NULL, 1 FROM items WHERE i = 2 AND form = 2
UNION ALL SELECT doc_id, 3, 'b', 'array', NULL, 0 FROM items WHERE i = 2 AND form = 2
UNION ALL SELECT doc_id, 2, 'prio', 'null', 'null', NULL FROM items WHERE i = 2 AND form = 2""",
    "json_compact_docs": _with(ORDER_LISTS, ORDER_FORMS) + "SELECT doc_id, compact FROM order_forms",
    "compact_order_lists": _with(ORDER_LISTS, ORDER_FORMS)
    + f"""SELECT doc_id, CASE WHEN shorter THEN compact ELSE text END AS output,
  CASE WHEN shorter THEN 'transformed' ELSE 'pass-through' END AS action
FROM (SELECT *, {_tokens('compact')} < {_tokens('text')} AS shorter FROM order_forms)""",
    # --- segments ---
    "fence_segments": _with(PROMPTS, SEGMENTS)
    + "SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, kind, source, text, CAST(confidence AS DOUBLE) AS confidence FROM segs",
    "nth_segment": _with(PROMPTS, SEGMENTS) + "SELECT doc_id, kind, text FROM segs WHERE seg_no = 2",
    "classify_documents": """WITH lined AS (
  SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
  FROM documents)
SELECT doc_id, CASE
  WHEN json_valid(text) THEN 'json'
  WHEN (contains(text, 'Traceback') OR regexp_matches(text, '\\bat [^\\n]*:\\d+')) AND len(ls) >= 2
    THEN 'stacktrace'
  WHEN len(ls) >= 2 AND contains(ls[1], ',') AND contains(ls[2], ',')
    AND len(list_distinct(list_transform(ls, lambda x: length(x) - length(replace(x, ',', ''))))) = 1
    THEN 'table'
  ELSE 'plain' END AS kind
FROM lined""".replace("\\\\", "\\"),
    "segment_type_counts": _with(PROMPTS, SEGMENTS)
    + "SELECT upper(kind) AS type, count(*) AS n FROM segs GROUP BY 1",
    "segment_line_ranges": _with(PROMPTS)
    + """, t_lines AS (SELECT *, length(t) - length(replace(t, chr(10), '')) AS nl,
    length(trimmed) - length(replace(trimmed, chr(10), '')) AS trimmed_nl,
    length(text) - length(replace(text, chr(10), '')) AS text_nl,
    length(text) - length(ltrim(text, chr(10) || ' ')) AS led FROM kinds)
SELECT doc_id, 1::BIGINT AS seg_no, 1::BIGINT AS line_start,
  CASE WHEN whole <> 'plain' THEN trimmed_nl + 1
    WHEN form = 3 THEN text_nl + 1 ELSE nl + 2 END AS line_end FROM t_lines
UNION ALL
SELECT doc_id, 2, nl + 4, CASE form WHEN 4 THEN nl + 4 + 1 + 2 * (turn + 2) ELSE nl + 4 END
FROM t_lines WHERE whole = 'plain' AND form IN (0, 2, 4)
UNION ALL
SELECT doc_id, 3, CASE form WHEN 4 THEN nl + 6 + 2 * (turn + 2) ELSE nl + 5 END,
  CASE form WHEN 0 THEN nl + 6 WHEN 2 THEN nl + 7 ELSE nl + 6 + 2 * (turn + 2) END
FROM t_lines WHERE whole = 'plain' AND form IN (0, 2, 4)""",
    "stack_elide": _with(TRACES)
    + f"""SELECT doc_id, CASE WHEN n < 6 THEN NULL
  WHEN n = 6 THEN E'Traceback (most recent call last):\\n' || array_to_string({_frames('1', 'n + 1')}, chr(10))
    || E'\\nValueError: ' || event_type || chr(10)
  ELSE E'Traceback (most recent call last):\\n' || array_to_string({_frames('1', '4')}, chr(10)) || chr(10)
    || CASE WHEN coded
         THEN array_to_string([E'[... 1 frames omitted ...]\\n    call()' for i in range(4, n - 2)], chr(10))
         ELSE '[... ' || (n - 6) || ' frames omitted ...]' END || chr(10)
    || array_to_string({_frames('n - 2', 'n + 1')}, chr(10)) || E'\\nValueError: ' || event_type || chr(10)
  END AS elided FROM trace_docs""",
    "stack_list_form": _with(TRACES)
    + """SELECT doc_id, E'trace:\\n  stack[' || (n * CASE WHEN coded THEN 2 ELSE 1 END + 2) || E']:\\n'
  || E'    - Traceback (most recent call last):\\n'
  || array_to_string(['    -   File "m' || i || '.py", line ' || i || ', in f' || chr(10)
       || CASE WHEN coded THEN E'    -     call()\\n' ELSE '' END for i in range(1, n + 1)], '')
  || '    - ValueError: ' || event_type || chr(10) AS block FROM trace_docs""",
    "delimited_rows": _with(DELIMITED)
    + """SELECT k AS doc_id, 0::BIGINT AS row_no, CASE form WHEN 0 THEN 'key|status|prio' ELSE 'key|status' END
  AS cells FROM delim WHERE form < 2
UNION ALL
SELECT k, 1, CASE form WHEN 0 THEN k || '|' || st || '|' || pr || ', "x"' ELSE k || '|' || st END
FROM delim WHERE form < 2
UNION ALL
SELECT k, 2, k || '|,' FROM delim WHERE form = 1""",
    "delimited_list_form": _with(DELIMITED)
    + """SELECT k AS doc_id, CASE form
  WHEN 0 THEN E'data[2]:\\n  -[3]:\\n    - key\\n    - status\\n    - prio\\n  -[3]:\\n    - ' || k
    || E'\\n    - ' || st || E'\\n    - ' || pr || E', "x"\\n'
  WHEN 1 THEN E'data[3]:\\n  -[2]:\\n    - key\\n    - status\\n  -[2]:\\n    - ' || k || E'\\n    - ' || st
    || E'\\n  -[2]:\\n    - ' || k || E'\\n    - ,\\n' END AS block FROM delim""",
    # --- scores, gates, compaction ---
    "compaction_score": _with(PROMPTS, SEGMENTS, SCORED)
    + """SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, kind, CAST(round(score, 4) AS DOUBLE) AS score,
  CAST(CASE kind WHEN 'json' THEN 0.85 WHEN 'yaml' THEN 0.75 WHEN 'log' THEN 0.8
    WHEN 'stacktrace' THEN 0.8 WHEN 'plain' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
  CASE kind WHEN 'plain' THEN 'prose' ELSE kind END AS label FROM scored""",
    "rule_toggle": _with(PROMPTS, SEGMENTS)
    + """SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, kind, kind <> 'yaml' AS enabled FROM segs""",
    "threshold_gate": _with(PROMPTS, SEGMENTS, SCORED)
    + """SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, kind, kind <> 'yaml' AND score >= 0.3 AS open
FROM scored""",
    "compact_documents": _with(PROMPTS, SEGMENTS, REWRITES) + COMPACTED,
    "compact_explanations": _with(PROMPTS, SEGMENTS, REWRITES)
    + """, notes AS (
  SELECT doc_id, string_agg(note, ' | ' ORDER BY seg_no) AS notes FROM (
    SELECT s.doc_id, s.seg_no, CASE s.kind
      WHEN 'json' THEN 'json: compressed json into compact format'
      WHEN 'log' THEN 'log: compressed with plugin builtin.log'
      WHEN 'stacktrace' THEN CASE WHEN s.elided
        THEN 'stacktrace: compressed with plugin builtin.stacktrace'
        ELSE 'stacktrace: compressed stack trace into compact format' END
      WHEN 'table' THEN 'table: compression score below threshold; kept original'
      WHEN 'yaml' THEN CASE WHEN ceil(length(s.rewritten) / 4.0) < ceil(length(s.text) / 4.0)
        THEN 'yaml: compressed with plugin builtin.yaml'
        ELSE 'yaml: compressed yaml into compact format' END
      ELSE CASE WHEN s.source IN ('fenced-python', 'mixed-tail') THEN 'plain: left as plain text' END
      END AS note
    FROM seg_texts s) WHERE note IS NOT NULL GROUP BY doc_id)
SELECT c.doc_id, concat_ws(' | ', n.notes, CASE WHEN c.revert
  THEN 'pass-through: rewrite did not reduce estimated tokens' END) AS notes
FROM compacted c LEFT JOIN notes n USING (doc_id)""",
    "segment_breakdown": _with(PROMPTS, SEGMENTS, REWRITES)
    + f"""SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, kind AS type,
  {_tokens('text')} AS input_tokens, {_tokens('coalesce(rewritten, text)')} AS output_tokens,
  {_tokens('text')} - {_tokens('coalesce(rewritten, text)')} AS tokens_saved,
  coalesce(rewritten, text) <> text AS changed FROM seg_texts""",
    "never_inflate": _with(PROPS)
    + f"""SELECT doc_id, output, CASE WHEN listed THEN 'transformed' ELSE 'pass-through' END AS action,
  CASE WHEN listed THEN 'ok' ELSE 'rewrite did not reduce estimated tokens' END AS reason,
  {_tokens('output')} - {_tokens('text')} AS delta_tokens FROM props_docs""",
    "size_and_rule_guards": _with(PROMPTS, SEGMENTS, REWRITES)
    + f""", later AS (
  SELECT k.doc_id, k.form, k.whole, octet_length(encode(k.text)) > 600 AS large,
    c.changed AND NOT (k.whole = 'plain' AND k.form = 0) AS changed,
    c.joined_tokens >= c.input_tokens AS longer
  FROM kinds k JOIN compacted c USING (doc_id))
SELECT doc_id,
  CASE WHEN NOT large AND changed AND NOT longer THEN 'transformed' ELSE 'pass-through' END AS action,
  CASE WHEN large THEN 'input exceeds max_input_bytes'
    WHEN changed AND longer THEN 'rewrite did not reduce estimated tokens' ELSE 'ok' END AS reason,
  NOT large AND whole = 'plain' AND form = 0 AS json_off
FROM later""",
    "result_summary": _with(PROPS)
    + f"""SELECT doc_id, CASE WHEN listed THEN 'transformed' ELSE 'pass-through' END AS action,
  CASE WHEN listed THEN 'ok' ELSE 'rewrite did not reduce estimated tokens' END AS reason,
  'heuristic-char4' AS estimator, {_tokens('text')} AS input_tokens, {_tokens('output')} AS output_tokens,
  {_tokens('output')} - {_tokens('text')} AS delta_tokens,
  CAST({_tokens('output')} - {_tokens('text')} AS DOUBLE) / {_tokens('text')} AS ratio
FROM props_docs""",
    "inspect_payload": _with(PROPS)
    + f"""SELECT doc_id, CASE WHEN listed THEN 'transformed' ELSE 'pass-through' END AS action,
  {_tokens('text')} - {_tokens('output')} AS tokens_saved,
  CAST(octet_length(encode(text)) AS BIGINT) AS bytes, 'json' AS type, 1::BIGINT AS line_end, output
FROM props_docs""",
    "changed_lines": _with(PROPS)
    + """, moved AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, 1 AS w FROM props_docs WHERE listed
  UNION ALL
  SELECT doc_id, unnest(string_split(rtrim(output, chr(10)), chr(10))), -1 FROM props_docs WHERE listed)
SELECT doc_id, CASE WHEN sum(w) > 0 THEN '-' ELSE '+' END AS sign, line,
  CAST(abs(sum(w)) AS BIGINT) AS n
FROM moved GROUP BY doc_id, line HAVING sum(w) <> 0""",
    "user_hooks": _with(PROPS)
    + f"""SELECT doc_id,
  CASE WHEN {_tokens("replace(text, '\"', '')")} < {_tokens('text')} THEN replace(text, '"', '')
    ELSE output END AS output,
  CASE WHEN {_tokens("replace(text, '\"', '')")} < {_tokens('text')} OR listed THEN 'transformed'
    ELSE 'pass-through' END AS action
FROM props_docs""",
    "python_hooks": _with(PROPS)
    + """SELECT doc_id, CASE WHEN listed THEN split_part(text, ',', 1) ELSE text END AS output,
  CASE WHEN listed THEN 'transformed' ELSE 'pass-through' END AS action,
  CASE WHEN listed THEN 6 ELSE 1 END::BIGINT AS input_tokens, 1::BIGINT AS output_tokens
FROM props_docs""",
    # --- metrics, audit, checks ---
    "metrics_totals": _with(RESULTS) + f"SELECT {COUNTERS} FROM results",
    "metrics_by_tool": _with(RESULTS) + f"SELECT tool, {COUNTERS} FROM results GROUP BY tool ORDER BY tool",
    "metrics_daily": _with(RESULTS)
    + f"SELECT CAST(ts AS DATE) AS day, {COUNTERS} FROM results GROUP BY 1 ORDER BY 1",
    "metrics_grouping_sets": _with(RESULTS)
    + f"""SELECT CASE WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END
  AS scope, tool, day, {COUNTERS}
FROM (SELECT *, CAST(ts AS DATE) AS day FROM results) GROUP BY GROUPING SETS ((), (tool), (day))""",
    "pass_through_reasons": _with(RESULTS)
    + "SELECT reason, count(*) AS n FROM results WHERE NOT transformed GROUP BY reason ORDER BY reason",
    "daily_ratio": _with(RESULTS)
    + """SELECT CAST(ts AS DATE) AS day, count(*) AS attempted,
  count(*) FILTER (WHERE transformed) AS applied,
  CAST(round_even(100.0 * count(*) FILTER (WHERE transformed) / count(*), 0) AS INTEGER) AS percent
FROM results GROUP BY 1""",
    "metrics_snapshot": _with(RESULTS)
    + """SELECT count(*) AS transforms_attempted, count(*) FILTER (WHERE transformed) AS transforms_applied,
  count(*) FILTER (WHERE NOT transformed) AS pass_through,
  CAST(sum(CASE WHEN transformed THEN input_tokens - output_tokens ELSE 0 END) AS BIGINT)
    AS estimated_token_delta_total,
  count(DISTINCT tool) AS tools, count(DISTINCT CAST(ts AS DATE)) AS days,
  CAST(sum(CASE WHEN transformed THEN input_tokens - output_tokens ELSE 0 END) AS BIGINT) AS delta_by_tool
FROM results""",
    "audit_filter_tail": _with(RESULTS)
    + rf""", found AS (
  SELECT *, 'sha256:' || sha256(regexp_replace(text, '{ENV}', '\1\2=***', 'g')) AS input_hash
  FROM results WHERE tool = 'src1' AND strftime(ts, '%Y-%m') = '2024-01'),
last AS (SELECT * FROM found ORDER BY ts DESC, input_hash DESC LIMIT 50)
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
  CASE WHEN transformed THEN 'transformed' ELSE 'pass-through' END AS action,
  output_tokens - input_tokens AS delta_tokens, input_hash FROM last""",
    "event_records": _with(PROPS)
    + """SELECT strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S') AS ts, 'transform' AS type,
  CASE WHEN listed THEN 'transformed' ELSE 'pass-through' END AS action,
  sha256(text) AS prompt_hash, 'json' AS segment_types, listed AS transformed
FROM props_docs""",
    "baseline_regression": _with(RESULTS)
    + """, cur AS (
  SELECT source AS name, round(CAST(sum(output_tokens) - sum(input_tokens) AS DOUBLE)
    / sum(input_tokens) * 100.0, 2) AS pct FROM results GROUP BY source),
base AS (
  SELECT source AS name, round(CAST(sum(output_tokens) - sum(input_tokens) AS DOUBLE)
    / sum(input_tokens) * 100.0, 2) AS pct
  FROM results WHERE lang <> 'en' AND source <> 'src7' GROUP BY source)
SELECT c.name, c.pct AS current_pct, b.pct AS baseline_pct,
  CASE WHEN b.name IS NULL THEN 'missing baseline fixture'
    WHEN c.pct > coalesce(b.pct, 0) + 0.05 THEN 'regression' ELSE 'ok' END AS verdict
FROM cur c LEFT JOIN base b USING (name)""",
    "set_equality": """WITH l AS (SELECT DISTINCT source AS tool FROM documents),
r AS (SELECT DISTINCT CASE WHEN source = 'src5' THEN 'other' ELSE source END AS tool FROM documents)
SELECT tool, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r)
UNION ALL SELECT tool, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""",
    # --- streams ---
    "stream_running_metrics": """SELECT CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS attempted,
  count(*) FILTER (WHERE event_id % 3 = 0) AS applied,
  count(*) FILTER (WHERE event_id % 3 <> 0) AS pass_through,
  CAST(sum(CASE WHEN event_id % 3 = 0 THEN user_id - user_id // 2 ELSE 0 END) AS BIGINT) AS tokens_saved
FROM events GROUP BY 1, 2""",
    "stream_compact_prompts": _with(PROMPTS, SEGMENTS, REWRITES)
    + f"SELECT doc_id, 0::BIGINT AS chunk_no, output, action, output_tokens FROM ({COMPACTED})",
    "stream_log_runs": _with(LOG_LINES, RUNS)
    + """
SELECT CAST(user_id AS VARCHAR) AS stream, first_id AS place, n,
  CASE WHEN n >= 3 THEN '[×' || n || '] ' || norm ELSE first_line END AS line FROM runs
UNION ALL
SELECT CAST(user_id AS VARCHAR), last_id, n, last_line FROM runs WHERE n = 2""",
    "stream_audit_append": _with(RESULTS)
    + """SELECT strftime(ts, '%Y-%m-%d') AS day, tool,
  CASE WHEN transformed THEN 'transformed' ELSE 'pass-through' END AS action,
  count(*) AS n, CAST(sum(output_tokens - input_tokens) AS BIGINT) AS delta_tokens
FROM results GROUP BY 1, 2, 3""",
}

# The live columns of a stream are those of the batch queries side by side.
ORACLES["stream_live_columns"] = rf"""
SELECT doc_id, kind, {_tokens('d.text')} AS tokens,
  'sha256:' || sha256(regexp_replace(d.text, '{ENV}', '\1\2=***', 'g')) AS input_hash
FROM documents d JOIN ({ORACLES['classify_documents']}) c USING (doc_id)"""

ORACLES["stored_baseline"] = ORACLES["baseline_regression"]
ORACLES["batch_hooks"] = ORACLES["python_hooks"]


def _snapshot_rows(rows: str, total: str = "", tool: str = "", reason: str = "") -> str:
    """Counter rows of ``rows``; the conditions say which rows a part counts."""
    block = COUNTERS if not total else COUNTERS.replace("WHERE transformed)", f"WHERE transformed AND {total})")
    return f"""SELECT 'total' AS scope, NULL AS key, {block} FROM {rows}
UNION ALL SELECT 'tool', tool, {COUNTERS} FROM {rows} WHERE {tool or 'true'} GROUP BY tool
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), {COUNTERS} FROM {rows} GROUP BY 2
UNION ALL SELECT 'reason', reason, count(*), 0, 0, 0 FROM {rows}
  WHERE NOT transformed AND {reason or 'true'} GROUP BY reason"""


LINE_TEXTS = """cut AS (
  SELECT c_custkey AS doc_id, c_mktsegment AS tool, DATE '2024-01-01' + (c_custkey % 3)::INTEGER AS ts,
    c_custkey % 4 = 0 AS prose, 'ERROR order ' || c_mktsegment[1] || ' is delayed' AS line,
    unnest(range(0, (c_custkey % 3 * 10 + 30 + 19) // 20)) AS chunk_no,
    c_custkey % 3 * 10 + 30 AS lines
  FROM customer),
sized_chunks AS (SELECT *, least(20, lines - 20 * chunk_no) AS n FROM cut),
chunks AS (
  SELECT *, NOT prose AS transformed, 'ok' AS reason, 25 * n AS chars,
    CASE WHEN prose THEN repeat('just some plain old word' || chr(10), n)
      ELSE '[×' || n || '] ' || line || chr(10) END AS output
  FROM sized_chunks),
results AS (
  SELECT *, CAST(ceil(chars / 4.0) AS BIGINT) AS input_tokens,
    CAST(ceil(length(output) / 4.0) AS BIGINT) AS output_tokens
  FROM chunks)"""

ORACLES |= {
    "metrics_snapshot_updates": _with(RESULTS) + _snapshot_rows("results"),
    "metrics_snapshot_damaged": _with(RESULTS)
    + _snapshot_rows(
        "results",
        total="doc_id % 3 <> 0",
        tool="(tool <> 'src1' OR doc_id % 3 <> 0)",
        reason="doc_id % 3 <> 0",
    ).replace(
        "AND doc_id % 3 <> 0) AS pass_through", ") AS pass_through"
    ),
    "stream_chunk_records": _with(LINE_TEXTS)
    + """SELECT doc_id, chunk_no, tool, output,
  CASE WHEN transformed THEN 'transformed' ELSE 'pass-through' END AS action, input_tokens, output_tokens
FROM results""",
    "stream_chunk_metrics": _with(LINE_TEXTS) + _snapshot_rows("results"),
    "audit_tail_file_order": _with(RESULTS)
    + rf""", hashed AS (
  SELECT tool, input_tokens,
    'sha256:' || sha256(regexp_replace(text, '{ENV}', '\1\2=***', 'g')) AS input_hash
  FROM results),
last AS (
  SELECT * FROM hashed ORDER BY input_tokens % 2 DESC, input_hash DESC, tool DESC LIMIT 40)
SELECT row_number() OVER (ORDER BY input_tokens % 2, input_hash, tool) - 1 AS place,
  '2024-03-01T00:00:00.000000+00:00' AS ts, tool, input_hash, input_tokens AS input_tokens_est
FROM last""",
    "texts_by_suffix": """SELECT c_mktsegment AS segment, count(*) AS lines,
  CAST(sum(length(c_name) + 1) AS BIGINT) AS chars FROM customer GROUP BY 1""",
    "same_members_docs": """SELECT doc_id, list_sort(list_distinct(
    list_transform(string_split(text, ' '), lambda w: length(w) % 5))) = range(0, doc_id % 3 + 3) AS same
FROM documents""",
    "line_changes": """WITH edits AS (SELECT o_orderkey AS k, o_orderkey % 6 + 1 AS d FROM orders),
numbered AS (SELECT k, d, unnest(range(1, 7)) AS i FROM edits),
entries AS (
  SELECT k AS doc_id, ' ' AS sign, i AS before_no,
    i - (i > d)::INT + (i > 3)::INT AS after_no, 'line ' || i || ' of ' || k AS line,
    i - (i > d)::INT AS gap, 0 AS rank
  FROM numbered WHERE i <> d
  UNION ALL
  SELECT k, '-', d, NULL, 'line ' || d || ' of ' || k, d - 1, 1 FROM edits
  UNION ALL
  SELECT k, '+', NULL, 4 - (d <= 3)::INT, 'new', 3 - (d <= 3)::INT, 2 FROM edits)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, rank) AS place, sign, before_no,
  after_no, line
FROM entries""",
    "tree_kept": """WITH made AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS tree, CASE WHEN o_orderkey % 3 = 0
    THEN 'orders[2]: of key ' || o_orderkey || E' without more to it\n'
    ELSE E'orders[2]:\n  id: ' || o_orderkey || E'\n  status: ' || o_orderstatus || E'\n' END AS text
  FROM orders)
SELECT doc_id, CASE WHEN tree THEN 'tree' ELSE 'plain' END AS kind,
  CASE WHEN tree THEN rtrim(text, chr(10)) ELSE text END AS output, 'pass-through' AS action,
  CASE WHEN tree THEN 'tree: tree-like input already compact; kept original' ELSE '' END AS notes
FROM made""",
    "log_block_form": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3
  WHEN 0 THEN E'data[2]{ts,level,msg}:\n  2024-01-01T00:00:00Z,ERROR,order ' || o_orderkey
    || E' late\n  2024-01-01T00:00:01Z,WARN,prio\\\\, ' || o_orderpriority || chr(10)
  WHEN 1 THEN E'data[2]{line}:\n  status ' || o_orderstatus || E'\n  status ' || o_orderstatus || chr(10)
  ELSE E'data[2]:\n  -\n    ts: 2024-01-01T00:00:00Z\n    level: ERROR\n    msg: order ' || o_orderkey
    || E' late\n  -\n    line: status ' || o_orderstatus || chr(10) END AS block
FROM orders""",
    "confidence_gate": _with(PROMPTS) + "SELECT doc_id, whole IN ('stacktrace', 'table') AS unsure FROM kinds",
    "unsupported_version": _with(PROMPTS)
    + """SELECT doc_id, text AS output, 'pass-through' AS action, 'unsupported format version 9' AS reason,
  'Skipped rewrite because format version 9 is unsupported.' AS notes FROM prompts""",
    "user_transformer": _with(PROPS)
    + f"""SELECT doc_id, CASE WHEN shorter THEN short ELSE text END AS output,
  CASE WHEN shorter THEN 'transformed' ELSE 'pass-through' END AS action
FROM (SELECT *, coalesce({_tokens('short')} < {_tokens('text')}, false) AS shorter FROM (
  SELECT *, 'k=' || json_extract_string(text, '$.k') AS short FROM props_docs))""",
}
