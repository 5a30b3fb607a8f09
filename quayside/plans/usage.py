"""Queries over usage reports, quotas and guards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import guards as G
from quayside.operators import usage as U
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query

NOW = "2024-01-01 20:00:00"
NOON = "2024-01-20 12:00:00"


@query("access_log_labelled", """
SELECT l.id, l.dataset_id, coalesce(d.name, '') AS dataset_name, l.user_id, trim(u.first_name || ' ' || u.last_name) AS user_name,
       l.token_id, t.label AS token_label, l.accessed_at, l.bytes
FROM access_log l LEFT JOIN datasets d ON l.dataset_id = d.id LEFT JOIN users u ON l.user_id = u.id
LEFT JOIN tokens t ON l.token_id = t.id""", "access_log datasets users tokens")
def access_log_labelled(portal: Portal) -> DataFrame:
    return U.access_log(portal.access_log(), portal.datasets(), portal.users(), portal.tokens())


@query("access_log_report", """
SELECT l.id, l.dataset_id, coalesce(d.name, '') AS dataset_name, l.user_id, trim(u.first_name || ' ' || u.last_name) AS user_name,
       l.token_id, t.label AS token_label, l.accessed_at, l.bytes
FROM access_log l LEFT JOIN datasets d ON l.dataset_id = d.id LEFT JOIN users u ON l.user_id = u.id
LEFT JOIN tokens t ON l.token_id = t.id WHERE l.accessed_at <= TIMESTAMP '2024-01-20 12:00:00' AND l.token_id = 7
ORDER BY l.accessed_at DESC, l.id DESC LIMIT 500""", "access_log datasets users tokens")
def access_log_report(portal: Portal) -> DataFrame:
    return U.access_log_report(portal.access_log(), portal.datasets(), portal.users(), portal.tokens(), end=NOON, token_id=7)


@query("replace_session_report", """
SELECT s.id, s.dataset_id, coalesce(d.name, '') AS dataset_name, s.status, s.created_at, s.user_id,
       trim(u.first_name || ' ' || u.last_name) AS user_name
FROM replace_sessions s LEFT JOIN datasets d ON s.dataset_id = d.id LEFT JOIN users u ON s.user_id = u.id
WHERE s.created_at >= TIMESTAMP '1997-01-01 00:00:00' AND s.status = 2
ORDER BY s.created_at DESC, s.id DESC LIMIT 500""", "replace_sessions datasets users")
def replace_session_report(portal: Portal) -> DataFrame:
    return U.replace_session_report(portal.replace_sessions(), portal.datasets(), portal.users(),
                                    start="1997-01-01 00:00:00", status=2).select(
        "id", "dataset_id", "dataset_name", "status", "created_at", "user_id", "user_name")


@query("requests_in_range", """
SELECT id, created_at FROM requests WHERE created_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00'""", "requests")
def requests_in_range(portal: Portal) -> DataFrame:
    return U.date_range(portal.requests(), "created_at", "2024-01-02 00:00:00", "2024-01-04 00:00:00").select("id", "created_at")


@query("daily_quota", """
SELECT date_trunc('day', accessed_at) AS day, 'notebook-public:' || strftime(accessed_at, '%Y%m%d') AS quota_key,
       count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) >= 16000000 AS exceeded
FROM access_log GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2"), "access_log")
def daily_quota(portal: Portal) -> DataFrame:
    return U.daily_quota(portal.access_log(), limit=16_000_000)


def sessions_sql(source: str, key: str, time: str, minutes: int, extra: str) -> str:
    """Gaps and islands in SQL."""
    return f"""
, marked AS (SELECT *, CASE WHEN {time} <= lag({time}) OVER (PARTITION BY {key} ORDER BY {time}) + INTERVAL {minutes} MINUTE
                       THEN 0 ELSE 1 END AS fresh FROM {source} WHERE {key} IS NOT NULL),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY {time} ROWS UNBOUNDED PRECEDING) AS run FROM marked),
islands AS (SELECT {key}, min({time}) AS window_start, max({time}) + INTERVAL {minutes} MINUTE AS window_end,
            count(*) AS events{extra} FROM runs GROUP BY {key}, run)
"""


_TOKENS = sessions_sql("access_log", "token_id", "accessed_at", 60, ", CAST(sum(bytes) AS BIGINT) AS bytes")


@query("token_windows", _TOKENS + "SELECT *, bytes >= 500000 AS exceeded FROM islands", "access_log")
def token_windows(portal: Portal) -> DataFrame:
    return U.token_windows(portal.access_log(), limit=500_000)


@query("token_quota_now", _TOKENS.replace("WHERE token_id IS NOT NULL", f"WHERE token_id IS NOT NULL AND accessed_at <= TIMESTAMP '{NOON}'")
       + f"SELECT *, bytes >= 500000 AS exceeded FROM islands WHERE window_end >= TIMESTAMP '{NOON}'", "access_log")
def token_quota_now(portal: Portal) -> DataFrame:
    return U.token_quota(portal.access_log(), NOON, limit=500_000)


_ATTEMPTS = "WITH attempts AS (SELECT lower(event_type || '-' || (user_id % 40)) AS who, ts FROM events)" + sessions_sql(
    "attempts", "who", "ts", 120, "")


@query("attempt_windows", _ATTEMPTS + "SELECT *, events > 5 AS limited FROM islands")
def attempt_windows(portal: Portal) -> DataFrame:
    attempts = portal.raw("events").select(F.upper(F.concat_ws("-", "event_type", F.col("user_id") % 40)).alias("who"), "ts")
    return U.attempt_windows(attempts, "who", "ts", limit=5, minutes=120)


@query("download_counts", """
SELECT f.id AS file_id, f.name, f.downloads + coalesce(n, 0) AS downloads
FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM downloads GROUP BY 1) d ON f.id = d.file_id""", "files downloads")
def download_counts(portal: Portal) -> DataFrame:
    return U.download_counts(portal.downloads(), portal.files())


@query("total_upload_size", "SELECT owner_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS files FROM files GROUP BY 1", "files")
def total_upload_size(portal: Portal) -> DataFrame:
    return U.total_upload_size(portal.files(), "size_bytes", "owner_id")


@query("valid_tokens", f"""
SELECT id, created_at FROM tokens WHERE revoked_at IS NULL AND TIMESTAMP '{NOW}' - created_at <= INTERVAL 12 HOUR""", "tokens")
def valid_tokens(portal: Portal) -> DataFrame:
    return U.valid_tokens(portal.tokens(), NOW).select("id", "created_at")


@query("user_tokens", "SELECT id, label, created_at FROM tokens WHERE user_id = 8", "tokens")
def user_tokens(portal: Portal) -> DataFrame:
    return U.user_tokens(portal.tokens(), 8).select("id", "label", "created_at")


@query("expired_sessions", """
SELECT id, status FROM replace_sessions WHERE created_at <= TIMESTAMP '2000-01-01 12:00:00' - INTERVAL 1 HOUR AND status NOT IN (3, 4)""", "replace_sessions")
def expired_sessions(portal: Portal) -> DataFrame:
    return U.expired_sessions(portal.replace_sessions(), "2000-01-01 12:00:00").select("id", "status")


@query("domains_in_use", """
SELECT id, domain FROM domains d WHERE EXISTS (SELECT 1 FROM users u WHERE u.org_id = d.org_id AND ends_with(u.email, '@' || d.domain))
   OR EXISTS (SELECT 1 FROM requests r WHERE r.org_id = d.org_id AND ends_with(r.email, '@' || d.domain))""", "domains users requests")
def domains_in_use(portal: Portal) -> DataFrame:
    return G.domains_in_use(portal.domains(), portal.users(), portal.requests()).select("id", "domain")


@query("deletable_organisations", """
SELECT id, name FROM organisations o WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.org_id = o.id)
   AND NOT EXISTS (SELECT 1 FROM requests r WHERE r.org_id = o.id)""", "organisations users requests")
def deletable_organisations(portal: Portal) -> DataFrame:
    return G.deletable_organisations(portal.organisations(), portal.users(), portal.requests()).select("id", "name")


@query("valid_domain_requests", """
SELECT r.id, r.email FROM requests r WHERE EXISTS (SELECT 1 FROM domains d
  WHERE d.org_id = r.org_id AND d.active AND lower(d.domain) = lower(split_part(r.email, '@', -1)))""", "requests domains")
def valid_domain_requests(portal: Portal) -> DataFrame:
    return G.valid_domain_requests(portal.requests(), portal.domains()).select("id", "email")


@query("duplicate_names", "SELECT lower(trim(name)) AS normal_name, count(*) AS n FROM devices GROUP BY 1 HAVING count(*) > 1", "devices")
def duplicate_names(portal: Portal) -> DataFrame:
    return G.duplicate_names(portal.devices())


@query("name_conflicts", """
SELECT id, name FROM devices WHERE lower(trim(name)) IN (SELECT lower(trim(name)) FROM devices GROUP BY 1 HAVING count(*) > 1)""", "devices")
def name_conflicts(portal: Portal) -> DataFrame:
    return G.name_conflicts(portal.devices()).select("id", "name")


@query("name_taken", "SELECT id FROM devices WHERE lower(trim(name)) = 'red widget' AND id <> 1", "devices")
def name_taken(portal: Portal) -> DataFrame:
    return G.name_taken(portal.devices(), " Red Widget ", own_id=1).select("id")


@query("pending_verified_requests", "SELECT id, email FROM requests WHERE status_id = 1 AND email_verified", "requests")
def pending_verified(portal: Portal) -> DataFrame:
    return G.pending_verified(portal.requests()).select("id", "email")


@query("active_administrators", "SELECT id, email FROM users WHERE role_id = 4 AND active", "users")
def active_administrators(portal: Portal) -> DataFrame:
    return G.active_administrators(portal.users()).select("id", "email")


@query("pending_index_jobs", """
SELECT s.dataset_id, s.section_type FROM sections s WHERE s.index_enabled AND s.index_status = 'pending'
  AND NOT EXISTS (SELECT 1 FROM datasets d WHERE d.id = s.dataset_id AND d.locked)""", "sections datasets")
def pending_index_jobs(portal: Portal) -> DataFrame:
    return G.pending_index_jobs(portal.sections(), portal.datasets()).select("dataset_id", "section_type")


_DOOMED = ", doomed AS (SELECT id FROM datasets WHERE owner_id < 100 AND NOT locked)\n"


def _deleted(portal: Portal) -> dict[str, DataFrame]:
    ids = portal.datasets().filter("owner_id < 100").select("id")
    return G.delete_datasets(ids, portal.datasets(), portal.sections(), portal.bridge())


@query("delete_datasets", _DOOMED + "SELECT id FROM datasets WHERE id NOT IN (SELECT id FROM doomed)", "datasets")
def delete_datasets(portal: Portal) -> DataFrame:
    return _deleted(portal)["datasets"].select("id")


@query("delete_dataset_sections", _DOOMED + "SELECT dataset_id, section_type FROM sections WHERE dataset_id NOT IN (SELECT id FROM doomed)", "datasets sections")
def delete_sections(portal: Portal) -> DataFrame:
    return _deleted(portal)["sections"].select("dataset_id", "section_type")


@query("delete_dataset_devices", _DOOMED + "SELECT dataset_id, device_id FROM bridge WHERE dataset_id NOT IN (SELECT id FROM doomed)", "datasets bridge")
def delete_bridge(portal: Portal) -> DataFrame:
    return _deleted(portal)["bridge"]


@query("next_codes", """
, numbered AS (SELECT lower(trim(label)) AS label,
  coalesce(max(TRY_CAST(regexp_extract(code, '(\\d{2})\\D*$', 1) AS INTEGER)), 0) + 1 AS next_number
  FROM sections WHERE trim(label) <> '' GROUP BY 1)
SELECT label, next_number, '20240131' || lpad(CAST(next_number AS VARCHAR), greatest(length(CAST(next_number AS VARCHAR)), 2)::INTEGER, '0') AS next_code
FROM numbered""", "sections")
def next_codes(portal: Portal) -> DataFrame:
    return G.next_codes(portal.sections(), dt.date(2024, 1, 31))


@query("latest_message", "SELECT id, content, updated_at FROM messages ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 1", "messages")
def latest_message(portal: Portal) -> DataFrame:
    return G.latest_message(portal.messages())
