"""Shared parts of the queries' SQL: the projected tables, for DuckDB."""

COMMITS = """commits AS (SELECT o_orderkey AS commit_key, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS commit_id, c_name AS author, 'change ' || o_orderstatus || chr(10) || 'body' AS message,
 'model-' || lower(substr(o_orderpriority, 1, 1)) AS model, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS started_at, o_orderdate AS committed_at, 'session-' || o_custkey AS session_id FROM orders JOIN customer ON o_custkey = c_custkey)"""

NOTE_LINES = """note_lines AS (SELECT commit_key, path, line_number, kind AS source_type, CASE WHEN kind = 'AIModified' THEN 1 - l_discount END AS similarity,
 CASE WHEN kind IN ('AI', 'AIModified') THEN 'e' || CAST(l_suppkey AS VARCHAR) END AS edit_id, CASE WHEN kind IN ('AI', 'AIModified') THEN l_suppkey % 4 END AS prompt_index
 FROM (SELECT *, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'AI' WHEN 'RO' THEN 'AI' WHEN 'AO' THEN 'AIModified' WHEN 'NF' THEN 'Human' WHEN 'NO' THEN 'Original' ELSE 'Unknown' END AS kind
 FROM (SELECT l_orderkey AS commit_key, 'src/f' || CAST(l_partkey % 50 AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS line_number, *,
 row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50, l_linenumber ORDER BY l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'AI' WHEN 'RO' THEN 'AI' WHEN 'AO' THEN 'AIModified' WHEN 'NF' THEN 'Human' WHEN 'NO' THEN 'Original' ELSE 'Unknown' END) AS pick FROM lineitem) WHERE pick = 1))"""

COUNTERS = """count(*) AS total_lines, count(*) FILTER (source_type = 'AI') AS ai_lines, count(*) FILTER (source_type = 'AIModified') AS ai_modified_lines, count(*) FILTER (source_type = 'Human') AS human_lines,
 count(*) FILTER (source_type = 'Original') AS original_lines, count(*) FILTER (source_type = 'Unknown') AS unknown_lines"""

NOTE_FILES = f"note_files AS (SELECT commit_key, path, {COUNTERS} FROM note_lines GROUP BY commit_key, path)"

PROMPTS = "prompts AS (SELECT conv_id AS commit_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS prompt_index, text, ['src/f' || (conv_id % 50)] AS affected_files FROM conversations WHERE role = 'user')"

BLAME = """blame AS (SELECT h.commit_key, h.path, h.line_number, h.orig_line, coalesce(n.source_type, 'Unknown') AS source_type, n.similarity, n.edit_id, n.prompt_index FROM
 (SELECT commit_key, path, final_start + k AS line_number, orig_start + k AS orig_line FROM (SELECT l_orderkey AS commit_key, 'src/f' || CAST(l_partkey % 50 AS VARCHAR) AS path, l_orderkey * 100 + l_linenumber * 10 AS final_start,
 CAST(l_linenumber AS BIGINT) AS orig_start, unnest(range(0, l_suppkey % 3 + 1)) AS k FROM lineitem)) h LEFT JOIN note_lines n ON n.commit_key = h.commit_key AND n.path = h.path AND n.line_number = h.orig_line)"""

PARENTS = "parents AS (SELECT o_orderkey AS commit_key, o_orderkey // 2 AS parent_key FROM orders WHERE o_orderkey > 0)"

AUDIT = """audit AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'export' WHEN 'purchase' THEN 'retention_apply' WHEN 'signup' THEN 'config_change' WHEN 'error' THEN 'redaction' END AS event, CAST(user_id AS VARCHAR) AS user FROM events)"""

RATIO = "coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def ratio(a: str, b: str) -> str:
    return RATIO.format(a=a, b=b)


def percent(a: str, b: str) -> str:
    return f"{ratio(a, b)} * 100.0"
