"""The portal tables once more, as DuckDB common table expressions for the SQL twins."""

from __future__ import annotations

_SECTION = """
  SELECT o_orderkey AS dataset_id, {label} AS label,
         strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS code,
         '{kind}.T_' || o_orderkey AS table_name, o_orderkey % 2 = 0 AS index_enabled, 'ts' AS index_time,
         CASE WHEN o_orderkey % 3 = 0 THEN 'sensor' END AS index_id,
         CASE WHEN o_orderkey % 4 = 0 THEN 'value' END AS index_include,
         CASE WHEN o_orderkey % 2 = 0 THEN 'IX_T_' || o_orderkey || '_time' END AS index_name,
         CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' END AS index_status,
         '{kind}' AS section_type
  FROM orders WHERE {present}"""

TABLES = {
    "datasets": """
  SELECT o_orderkey AS id, 'Dataset ' || o_orderkey || ' ' || o_orderpriority AS name,
         CASE WHEN o_orderstatus <> 'P' THEN 'status ' || o_orderstatus || ' priority ' || o_orderpriority END AS description,
         CASE o_orderkey % 8
           WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' B'
           WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' KB'
           WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5 MB'
           WHEN 3 THEN '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '   gb '
           WHEN 4 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' TB'
           WHEN 5 THEN 'unknown'
           WHEN 6 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' PB' END AS size_text,
         CAST(o_orderkey % 4 + 1 AS INTEGER) AS visibility, o_custkey AS owner_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS licence_id, o_orderkey % 7 AS site_id,
         CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS energy_type_id,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS updated_at,
         o_orderkey % 3 <> 0 AS allow_api, o_orderkey % 5 <> 0 AS allow_download,
         o_orderkey % 2 = 0 AS anonymised, o_orderkey % 3 = 1 AS time_series, o_orderkey % 11 = 0 AS locked,
         CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS event_logs_id,
         CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey END AS context_id
  FROM orders""",
    "users": """
  SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         lower(split_part(c_name, '#', 1) || '.' || split_part(c_name, '#', 2) || '@' ||
               CASE WHEN c_custkey % 13 = 0 THEN 'other.org' ELSE 'nation' || c_nationkey || '.org' END) AS email,
         c_nationkey AS org_id, CAST(c_custkey % 4 + 1 AS INTEGER) AS role_id, c_custkey % 10 <> 0 AS active
  FROM customer""",
    "organisations": """
  SELECT n_nationkey AS id, n_name AS name, n_nationkey % 6 <> 0 AS active FROM nation
  UNION ALL SELECT r_regionkey + 100, r_name, true FROM region""",
    "domains": """
  SELECT n_nationkey AS id, n_nationkey AS org_id, 'nation' || n_nationkey || '.org' AS domain,
         n_nationkey % 7 <> 0 AS active FROM nation
  UNION ALL SELECT n_nationkey + 1000, n_nationkey, 'unused' || n_nationkey || '.org', true FROM nation""",
    "requests": """
  SELECT s_suppkey AS id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
         's' || s_suppkey || '@NATION' || s_nationkey || '.org' AS email, s_nationkey AS org_id,
         CAST(s_suppkey % 3 + 1 AS INTEGER) AS status_id, s_suppkey % 2 = 0 AS email_verified,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INTEGER)) AS created_at
  FROM supplier""",
    "licences": """
  SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS label,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <> 4 AS active FROM orders""",
    "sites": "\n  SELECT s_suppkey AS id, s_name AS name, s_suppkey % 3 <> 0 AS active FROM supplier",
    "energy_types": "\n  SELECT r_regionkey AS id, r_name AS label FROM region",
    "visibilities": """
  SELECT * FROM (VALUES (1, 'Public'), (2, 'Private'), (3, 'Internal'), (4, 'Personal')) AS v(id, label)""",
    "devices": """
  SELECT p_partkey AS id, p_name AS name, p_brand AS manufacturer, p_type AS model, p_size AS capacity,
         p_size > 10 AS active FROM part""",
    "bridge": "\n  SELECT DISTINCT l_orderkey AS dataset_id, l_partkey AS device_id FROM lineitem",
    "sections": "\n  UNION ALL".join([
        _SECTION.format(kind="donnees", label="o_orderstatus || ' ' || o_orderpriority", present="true"),
        _SECTION.format(kind="donnees_event_logs",
                        label="' Events ' || o_orderstatus || ' ' || o_orderpriority || ' '",
                        present="o_orderkey % 4 = 1"),
        _SECTION.format(kind="donnees_contexte_environnemental",
                        label="'Context ' || o_orderstatus || ' ' || o_orderpriority",
                        present="o_orderkey % 9 = 0")]),
    "access_log": """
  SELECT event_id AS id, CAST(floor(value * 30) AS BIGINT) AS dataset_id,
         CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
         CASE WHEN event_id % 3 <> 0 THEN user_id % 20 END AS token_id,
         ts AS accessed_at, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events""",
    "tokens": """
  SELECT c_custkey AS id, c_custkey % 50 AS user_id, 'token ' || c_custkey AS label,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey % 2000 AS INTEGER)) AS created_at,
         CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00'
              + to_minutes(CAST(c_custkey % 2000 AS INTEGER)) + INTERVAL 1 HOUR END AS revoked_at
  FROM customer""",
    "replace_sessions": """
  SELECT 'job-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderkey AS dataset_id,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS user_id, 'T_' || o_orderkey AS table_name,
         CAST(o_orderkey % 5 AS INTEGER) AS status,
         o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS created_at FROM orders""",
    "files": """
  SELECT doc_id AS id, 'Document ' || doc_id AS name, source || '/' || doc_id || '.txt' AS original_name,
         CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256,
         CAST(doc_id % 4 + 1 AS INTEGER) AS visibility, doc_id % 150 AS owner_id,
         CAST(doc_id % 5 + 1 AS INTEGER) AS licence_id, CAST(0 AS BIGINT) AS downloads FROM documents""",
    "downloads": "\n  SELECT event_id AS id, user_id AS file_id, ts AS at FROM events",
    "messages": """
  SELECT o_orderkey AS id, o_orderpriority AS content, o_orderdate AS updated_at FROM orders""",
    # Datasets with the owner's organisation and name.
    "owned": """
  SELECT d.*, u.org_id AS owner_org_id, trim(u.first_name || ' ' || u.last_name) AS owner_name
  FROM datasets d LEFT JOIN users u ON d.owner_id = u.id""",
}

_NEEDS = {"owned": ("datasets", "users")}


def with_tables(names: str, body: str) -> str:
    """``WITH`` clause for the named portal tables, then the body."""
    wanted: list[str] = []
    for name in names.split():
        for part in (*_NEEDS.get(name, ()), name):
            if part not in wanted:
                wanted.append(part)
    clauses = ",\n".join(f"{name} AS ({TABLES[name]})" for name in wanted)
    return f"WITH {clauses}\n{body}" if clauses else body
