"""Queries over the dataset catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import catalog as C
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query
from quayside.sources.tables import resolve_table

MEMBER = C.Viewer(user_id=17, role_id=C.USER, org_id=5)
OBSERVER = C.Viewer(user_id=20, role_id=C.OBSERVER, org_id=5)
EDITOR = C.Viewer(user_id=18, role_id=C.EDITOR, org_id=5)
ADMIN = C.Viewer(user_id=19, role_id=C.ADMINISTRATOR, org_id=5)

_MEMBER_SEES = "(visibility IN (1, 2) OR (visibility = 3 AND owner_org_id = 5) OR (visibility = 4 AND owner_id = 17))"
_EDITOR_SEES = _MEMBER_SEES.replace("17", "18")
_OBSERVER_SEES = "(visibility IN (1, 2) OR (visibility = 4 AND owner_id = 20))"


def owned(portal: Portal) -> DataFrame:
    return C.with_owner(portal.datasets(), portal.users())


@query("visible_to_anonymous", "SELECT id, visibility FROM owned WHERE visibility = 1", "owned")
def visible_anonymous(portal: Portal) -> DataFrame:
    return C.visible_to(owned(portal), C.ANONYMOUS).select("id", "visibility")


@query("visible_to_member", f"SELECT id, visibility, owner_id FROM owned WHERE {_MEMBER_SEES}", "owned")
def visible_member(portal: Portal) -> DataFrame:
    return C.visible_to(owned(portal), MEMBER).select("id", "visibility", "owner_id")


@query("visible_to_observer", f"SELECT id, visibility FROM owned WHERE {_OBSERVER_SEES}", "owned")
def visible_observer(portal: Portal) -> DataFrame:
    return C.visible_to(owned(portal), OBSERVER).select("id", "visibility")


@query("visible_to_administrator", "SELECT id, visibility FROM owned", "owned")
def visible_administrator(portal: Portal) -> DataFrame:
    return C.visible_to(owned(portal), ADMIN).select("id", "visibility")


@query("access_decisions", """
SELECT l.id, l.dataset_id, l.user_id, coalesce(o.visibility = 1 OR (o.visibility = 2 AND v.id IS NOT NULL)
  OR (o.visibility = 3 AND (v.role_id = 4 OR (v.role_id IN (2, 3) AND v.org_id = o.owner_org_id)))
  OR (o.visibility = 4 AND (v.role_id = 4 OR v.id = o.owner_id)), false) AS allowed
FROM access_log l LEFT JOIN owned o ON l.dataset_id = o.id LEFT JOIN users v ON l.user_id = v.id""", "owned access_log")
def access_decisions(portal: Portal) -> DataFrame:
    requests = portal.access_log().select("id", "dataset_id", "user_id").withColumnRenamed("id", "request_id")
    return C.access_decisions(requests, portal.datasets(), portal.users()).withColumnRenamed("request_id", "id")


@query("search_datasets", """
SELECT id, name, description FROM datasets WHERE contains(lower(name), 'urgent') OR contains(lower(description), 'status o')""", "datasets")
def search_datasets(portal: Portal) -> DataFrame:
    return C.search(portal.datasets(), "URGENT", ["name"]).unionByName(
        C.search(portal.datasets(), "Status O", ["description"])).select("id", "name", "description").distinct()


@query("search_documents", "SELECT doc_id FROM documents WHERE contains(text, 'the') OR contains(lang, 'the')")
def search_documents(portal: Portal) -> DataFrame:
    return C.search(portal.raw("documents"), "the", ["text", "lang"], case_sensitive=True).select("doc_id")


@query("filter_datasets", "SELECT id FROM datasets WHERE licence_id = 2 AND anonymised AND NOT time_series", "datasets")
def filter_datasets(portal: Portal) -> DataFrame:
    return C.filter_optional(portal.datasets(), licence_id=2, anonymised=True, time_series=False, owner_id=None).select("id")


@query("has_section_datasets", "SELECT id FROM datasets WHERE event_logs_id IS NOT NULL AND context_id IS NOT NULL", "datasets")
def has_section_datasets(portal: Portal) -> DataFrame:
    return C.has_section(portal.datasets(), event_logs=True, context=True).select("id")


_SIZE = """, parts AS (SELECT *, regexp_split_to_array(trim(size_text), ' +') AS p FROM datasets), sized AS (
SELECT *, CASE WHEN len(p) = 2 THEN TRY_CAST(p[1] AS DOUBLE) * CASE upper(p[2]) WHEN 'B' THEN 1.0 / 1048576 WHEN 'KB' THEN 1.0 / 1024
  WHEN 'MB' THEN 1.0 WHEN 'GB' THEN 1024.0 WHEN 'TB' THEN 1048576.0 END END AS mb FROM parts)
"""


@query("size_between_datasets", _SIZE + "SELECT id FROM sized WHERE mb >= 100 AND mb <= 500000.5", "datasets")
def size_between_datasets(portal: Portal) -> DataFrame:
    return C.size_between(portal.datasets(), 100, 500000.5).select("id")


@query("size_between_files", "SELECT id, size_bytes FROM files WHERE size_bytes / 1048576.0 >= 0.001 AND size_bytes / 1048576.0 <= 0.01", "files")
def size_between_files(portal: Portal) -> DataFrame:
    return C.bytes_between(portal.files(), "size_bytes", 0.001, 0.01).select("id", "size_bytes")


@query("active_licences", "SELECT id, label FROM licences WHERE active", "licences")
def active_licences(portal: Portal) -> DataFrame:
    return C.lookup_items(C.active_only(portal.licences()), "id", "label")


@query("servable_public", "SELECT id FROM datasets WHERE allow_api AND NOT locked AND visibility = 1", "datasets")
def servable_public(portal: Portal) -> DataFrame:
    return C.servable(portal.datasets(), "public").select("id")


@query("servable_private", f"SELECT id FROM owned WHERE allow_api AND NOT locked AND {_MEMBER_SEES}", "owned")
def servable_private(portal: Portal) -> DataFrame:
    return C.servable(owned(portal), "private", MEMBER).select("id")


@query("servable_hub", f"SELECT id FROM owned WHERE allow_api AND NOT locked AND {_EDITOR_SEES} AND owner_id = 18", "owned")
def servable_hub(portal: Portal) -> DataFrame:
    return C.servable(owned(portal), "hub", EDITOR).select("id")


@query("servable_export", f"SELECT id FROM owned WHERE allow_download AND NOT locked AND {_MEMBER_SEES}", "owned")
def servable_export(portal: Portal) -> DataFrame:
    return C.servable(owned(portal), "export", MEMBER).select("id")


@query("catalogue_star", """
SELECT d.id, d.name, d.owner_name, g.name AS owner_org_name, l.label AS licence, s.name AS site,
       v.label AS visibility_label, e.label AS energy_type
FROM owned d LEFT JOIN organisations g ON d.owner_org_id = g.id LEFT JOIN licences l ON d.licence_id = l.id
LEFT JOIN sites s ON d.site_id = s.id LEFT JOIN visibilities v ON d.visibility = v.id
LEFT JOIN energy_types e ON d.energy_type_id = e.id""", "owned organisations licences sites visibilities energy_types")
def catalogue_star(portal: Portal) -> DataFrame:
    return star(portal).select("id", "name", "owner_name", "owner_org_name", "licence", "site", "visibility_label", "energy_type")


def star(portal: Portal) -> DataFrame:
    return C.star(portal.datasets(), portal.users(), portal.organisations(), portal.licences(), portal.sites(),
                  portal.visibilities(), portal.energy_types())


@query("catalogue_search", _SIZE.replace("datasets)", "owned)", 1) + f"""
SELECT id, name, owner_org_id FROM sized WHERE {_MEMBER_SEES} AND contains(lower(name), 'high')
  AND licence_id = 2 AND allow_api AND mb >= 1""", "owned")
def catalogue_search(portal: Portal) -> DataFrame:
    """The whole search form in one plan: visibility, text, flags and size."""
    rows = C.visible_to(owned(portal), MEMBER)
    rows = C.search(rows, "high", ["name", "description"])
    rows = C.filter_optional(rows, licence_id=2, allow_api=True)
    return C.size_between(rows, 1).select("id", "name", "owner_org_id")


@query("dataset_devices", """
SELECT d.id AS dataset_id, d.name AS dataset_name, b.device_id, v.name AS device_name, v.manufacturer, v.model
FROM datasets d JOIN bridge b ON d.id = b.dataset_id JOIN devices v ON b.device_id = v.id""", "datasets bridge devices")
def dataset_devices(portal: Portal) -> DataFrame:
    return C.dataset_devices(portal.datasets(), portal.bridge(), portal.devices())


@query("files_star", """
SELECT f.id, f.name, trim(u.first_name || ' ' || u.last_name) AS owner_name, g.name AS owner_org_name, l.label AS licence, v.label AS visibility_label
FROM files f LEFT JOIN users u ON f.owner_id = u.id LEFT JOIN organisations g ON u.org_id = g.id
LEFT JOIN licences l ON f.licence_id = l.id LEFT JOIN visibilities v ON f.visibility = v.id""",
       "files users organisations licences visibilities")
def files_star(portal: Portal) -> DataFrame:
    return C.star_files(portal.files(), portal.users(), portal.organisations(), portal.licences(), portal.visibilities()).select(
        "id", "name", "owner_name", "owner_org_name", "licence", "visibility_label")


@query("dataset_sections", """
SELECT d.id, 'donnees.T_' || d.id AS main_table,
  CASE WHEN d.event_logs_id IS NOT NULL THEN 'donnees_event_logs.T_' || d.id END AS event_logs_table,
  CASE WHEN d.context_id IS NOT NULL THEN 'donnees_contexte_environnemental.T_' || d.id END AS context_table FROM datasets d""", "datasets")
def dataset_sections(portal: Portal) -> DataFrame:
    return C.dataset_sections(portal.datasets(), portal.sections()).select("id", "main_table", "event_logs_table", "context_table")


@query("facets_visible", f"""
, seen AS (SELECT * FROM owned WHERE {_MEMBER_SEES})
SELECT DISTINCT 'creator' AS facet, owner_id AS id, owner_name AS label FROM seen WHERE owner_name IS NOT NULL
UNION ALL SELECT DISTINCT 'organisation', g.id, g.name FROM seen JOIN organisations g ON seen.owner_org_id = g.id
UNION ALL SELECT DISTINCT 'visibility', v.id, v.label FROM seen JOIN visibilities v ON seen.visibility = v.id""",
       "owned organisations visibilities")
def facets_visible(portal: Portal) -> DataFrame:
    return C.facets(C.visible_to(star(portal), MEMBER))


@query("latest_datasets", """
SELECT id, updated_at FROM datasets WHERE visibility = 1 ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 6""", "datasets")
def latest_datasets(portal: Portal) -> DataFrame:
    return C.latest_datasets(C.visible_to(portal.datasets(), C.ANONYMOUS)).select("id", "updated_at")


@query("index_jobs", """
SELECT s.dataset_id, s.section_type, coalesce(d.name, s.label) AS dataset_name, s.table_name,
  coalesce(s.index_name, '') AS index_name, coalesce(s.index_status, 'not enabled') AS index_status,
  s.index_time, s.index_id, s.index_include
FROM sections s LEFT JOIN datasets d ON s.dataset_id = d.id""", "sections datasets")
def index_jobs(portal: Portal) -> DataFrame:
    return C.index_jobs(portal.sections(), portal.datasets())


@query("union_sections", "SELECT dataset_id, section_type, code FROM sections", "sections")
def union_sections(portal: Portal) -> DataFrame:
    parts = portal.section_parts()
    return C.union_sections(parts["donnees"], parts["donnees_event_logs"], parts["donnees_contexte_environnemental"]).select(
        "dataset_id", "section_type", "code")


@query("resolve_table_name", "SELECT dataset_id, section_type FROM sections WHERE upper(split_part(table_name, '.', 2)) = 'T_45'", "sections")
def resolve_table_name(portal: Portal) -> DataFrame:
    return resolve_table(portal.sections(), " t_45 ").select("dataset_id", "section_type")


@query("sorted_lookups", "SELECT id, name AS label FROM devices", "devices")
def sorted_lookups(portal: Portal) -> DataFrame:
    return C.lookup_items(portal.devices(), "id", "name")
