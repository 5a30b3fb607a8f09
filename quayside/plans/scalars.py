"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.sizes import format_size, parse_size_bytes, parse_size_mb
from quayside.functions.text import (
    csv_escape, display_name, email_domain, energy_icon, normalise_section, safe_file_name, slug, suffix_number,
    truncate, valid_domain, valid_identifier)
from quayside.plans.portal_tables import Portal
from quayside.plans.registry import query


@query("slug_labels", """
SELECT dataset_id, section_type,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(label), '\\s+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-')
  || '-' || code AS slug FROM sections""", "sections")
def slug_labels(portal: Portal) -> DataFrame:
    return portal.sections().select("dataset_id", "section_type", slug(F.col("label"), F.col("code")).alias("slug"))


@query("suffix_numbers", """
SELECT dataset_id, section_type,
  coalesce(TRY_CAST(regexp_extract(code || CASE WHEN dataset_id % 3 = 0 THEN '-x' ELSE '' END, '(\\d{2})\\D*$', 1) AS INTEGER), 0) AS suffix
FROM sections""", "sections")
def suffix_numbers(portal: Portal) -> DataFrame:
    code = F.concat("code", F.when(F.col("dataset_id") % 3 == 0, F.lit("-x")).otherwise(F.lit("")))
    return portal.sections().select("dataset_id", "section_type", suffix_number(code).alias("suffix"))


@query("display_names", "SELECT id, trim(first_name || ' ' || last_name) AS display_name FROM users", "users")
def display_names(portal: Portal) -> DataFrame:
    return portal.users().select("id", display_name(F.col("first_name"), F.col("last_name")).alias("display_name"))


@query("energy_icons", """
SELECT doc_id, CASE
  WHEN contains(lower(text), 'wind') OR contains(lower(text), 'éolien') OR contains(lower(text), 'eolien') THEN 'wind_power'
  WHEN contains(lower(text), 'solar') OR contains(lower(text), 'solaire') OR contains(lower(text), 'photovolta') THEN 'solar_power'
  WHEN contains(lower(text), 'hydro') OR contains(lower(text), 'water') THEN 'water_ec'
  ELSE 'energy_savings_leaf' END AS icon FROM documents""")
def energy_icons(portal: Portal) -> DataFrame:
    return portal.raw("documents").select("doc_id", energy_icon(F.col("text")).alias("icon"))


@query("csv_escape_documents", """
SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS escaped
FROM documents""")
def csv_escape_documents(portal: Portal) -> DataFrame:
    return portal.raw("documents").select("doc_id", F.sha2(csv_escape(F.col("text")), 256).alias("escaped"))


@query("safe_file_names", """
SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[<>:"|?*/\\\\]', '_', 'g')), 1, 120), ''), 'dataset-export') AS file_name
FROM pages""")
def safe_file_names(portal: Portal) -> DataFrame:
    return portal.raw("pages").select("page_id", safe_file_name(F.col("url")).alias("file_name"))


@query("section_aliases", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'donnees' WHEN 1 THEN 'donnees_event_logs'
  WHEN 2 THEN 'donnees_contexte_environnemental' END AS section FROM orders""")
def section_aliases(portal: Portal) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    alias = (F.when(kind == 0, F.lit("Donnees")).when(kind == 1, F.lit("event-logs"))
             .when(kind == 2, F.lit("Contexte_Env ")).otherwise(F.col("o_orderpriority")))
    return portal.raw("orders").select("o_orderkey", normalise_section(alias).alias("section"))


@query("identifier_checks", """
SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9_-]+') AS name_ok, regexp_full_match(p_type, '[A-Za-z0-9_-]+') AS type_ok FROM part""")
def identifier_checks(portal: Portal) -> DataFrame:
    return portal.raw("part").select("p_partkey", valid_identifier(F.col("p_name")).alias("name_ok"),
                                     valid_identifier(F.col("p_type")).alias("type_ok"))


@query("email_domains", """
SELECT id, split_part(email, '@', -1) AS domain,
  contains(split_part(email, '@', -1), '.') AND NOT starts_with(split_part(email, '@', -1), '.')
  AND NOT ends_with(split_part(email, '@', -1), '.') AS domain_ok FROM users""", "users")
def email_domains(portal: Portal) -> DataFrame:
    domain = email_domain(F.col("email"))
    return portal.users().select("id", domain.alias("domain"), valid_domain(domain).alias("domain_ok"))


@query("truncated_texts", """
SELECT doc_id, sha256(substr(text, 1, 200)) AS warning, length(substr(text, 1, 1000)) AS error_length FROM documents""")
def truncated_texts(portal: Portal) -> DataFrame:
    """Display limits of warnings and index errors; the stored text stays whole."""
    return portal.raw("documents").select(
        "doc_id", F.sha2(truncate(F.col("text")), 256).alias("warning"),
        F.length(truncate(F.col("text"), 1000)).cast("bigint").alias("error_length"))


_MB = """CASE WHEN len(p) = 2 THEN TRY_CAST(p[1] AS DOUBLE) * CASE upper(p[2]) WHEN 'B' THEN 1.0 / 1048576
  WHEN 'KB' THEN 1.0 / 1024 WHEN 'MB' THEN 1.0 WHEN 'GB' THEN 1024.0 WHEN 'TB' THEN 1048576.0 END END"""


@query("parse_sizes", f"""
, parts AS (SELECT id, size_text, regexp_split_to_array(trim(size_text), ' +') AS p FROM datasets)
SELECT id, size_text, round({_MB}, 6) AS size_mb, coalesce(CAST(floor(({_MB}) * 1048576) AS BIGINT), 0) AS size_bytes
FROM parts""", "datasets")
def parse_sizes(portal: Portal) -> DataFrame:
    return portal.datasets().select("id", "size_text", F.round(parse_size_mb(F.col("size_text")), 6).alias("size_mb"),
                                    parse_size_bytes(F.col("size_text")).alias("size_bytes"))


@query("format_sizes", """
, sized AS (SELECT id, size_bytes * (1 + id % 7) * (1 + id % 1021) * (1 + id % 509) AS b FROM files)
SELECT id, CASE WHEN b < 1024 THEN b || ' B' WHEN b / 1024.0 < 1024 THEN CAST(round(b / 1024.0::DOUBLE, 1) AS VARCHAR) || ' KB'
  WHEN b / 1048576.0 < 1024 THEN CAST(round(b / 1048576.0::DOUBLE, 1) AS VARCHAR) || ' MB'
  ELSE CAST(round(b / 1073741824.0::DOUBLE, 1) AS VARCHAR) || ' GB' END AS size_label FROM sized""", "files")
def format_sizes(portal: Portal) -> DataFrame:
    key = F.col("id")
    size = F.col("size_bytes") * (key % 7 + 1) * (key % 1021 + 1) * (key % 509 + 1)
    return portal.files().select("id", format_size(size).alias("size_label"))


@query("content_hashes", "SELECT id, sha256, size_bytes FROM files", "files")
def content_hashes(portal: Portal) -> DataFrame:
    return portal.files().select("id", "sha256", "size_bytes")
