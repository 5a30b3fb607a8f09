"""Dataset catalogue: visibility rules, filters, search, facets and star joins.

Expected columns: datasets(id, name, description, size_text, visibility, owner_id, ...),
users(id, first_name, last_name, org_id, role_id, ...). Everything stays one declarative plan, the
size filter included. A lookup side is broadcast only on a known or counted size (``lookup_side``);
otherwise Spark splits hot keys (AQE).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.errors import RequestError
from quayside.functions.sizes import parse_size_mb
from quayside.functions.text import display_name
from quayside.storage import lookup_side

# Visibility and role numbers.
PUBLIC, PRIVATE, INTERNAL, PERSONAL = 1, 2, 3, 4
OBSERVER, USER, EDITOR, ADMINISTRATOR = 1, 2, 3, 4
# Index job states.
NOT_ENABLED, PENDING, RUNNING, COMPLETED, FAILED = "not enabled", "pending", "running", "completed", "failed"


@dataclass(frozen=True)
class Viewer:
    """The user a query runs for; no id means not signed in."""

    user_id: int | None = None
    role_id: int | None = None
    org_id: int | None = None


ANONYMOUS = Viewer()


def visibility_rule(visibility: Column, owner_id: Column, owner_org: Column, user_id: Column,
                    role_id: Column, org_id: Column) -> Column:
    """Whether a user may see a row. Never NULL."""
    signed_in = user_id.isNotNull()
    admin = role_id == ADMINISTRATOR
    same_org = role_id.isin(USER, EDITOR) & (owner_org == org_id)
    rule = (
        (visibility == PUBLIC)
        | ((visibility == PRIVATE) & signed_in)
        | ((visibility == INTERNAL) & signed_in & (admin | same_org))
        | ((visibility == PERSONAL) & (admin | (owner_id == user_id)))
    )
    return F.coalesce(rule, F.lit(False))


def with_owner(df: DataFrame, users: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Left join of the owner; adds ``owner_org_id`` and ``owner_name``."""
    owners = users.select(
        F.col("id").alias("_owner"), F.col("org_id").alias("owner_org_id"),
        display_name(F.col("first_name"), F.col("last_name")).alias("owner_name"))
    return df.join(owners, df[owner] == F.col("_owner"), "left").drop("_owner")


def visible_to(df: DataFrame, viewer: Viewer, owner_org: str = "owner_org_id") -> DataFrame:
    """Rows one viewer may see. Constant folding leaves only the branches that apply; the owner
    organisation is needed for internal rows of ordinary users and editors alone."""
    literal = [F.lit(v).cast("bigint") for v in (viewer.user_id, viewer.role_id, viewer.org_id)]
    org = F.col(owner_org) if owner_org in df.columns else F.lit(None).cast("bigint")
    return df.filter(visibility_rule(F.col("visibility"), F.col("owner_id"), org, *literal))


def access_decisions(requests: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """The rule for many (dataset_id, user_id) requests at once, by equi-joins only."""
    owned = with_owner(datasets.select("id", "visibility", "owner_id"), users)
    asked = requests.join(owned, requests["dataset_id"] == owned["id"], "left").drop("id")
    viewers = users.select(F.col("id").alias("_viewer"), "role_id", "org_id")
    joined = asked.join(viewers, asked["user_id"] == F.col("_viewer"), "left")
    allowed = visibility_rule(*[F.col(c) for c in (
        "visibility", "owner_id", "owner_org_id", "_viewer", "role_id", "org_id")])
    return joined.select(*requests.columns, allowed.alias("allowed"))


def contains_text(column: Column, text: str, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return column.contains(text)
    return F.lower(column).contains(text.lower())


def search(df: DataFrame, text: str | None, columns: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """Rows where any of the columns contains the text; blank text keeps all rows."""
    if not text or not text.strip():
        return df
    hits = [F.coalesce(contains_text(F.col(c), text, case_sensitive), F.lit(False)) for c in columns]
    return df.filter(reduce(Column.__or__, hits))


def filter_optional(df: DataFrame, **wanted) -> DataFrame:
    """``column = value`` for every value given; None adds nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def has_section(df: DataFrame, event_logs: bool | None = None, context: bool | None = None) -> DataFrame:
    """Datasets with an event-log / context section; only True asks for it."""
    if event_logs:
        df = df.filter(F.col("event_logs_id").isNotNull())
    if context:
        df = df.filter(F.col("context_id").isNotNull())
    return df


def size_between(df: DataFrame, minimum: float | None = None, maximum: float | None = None,
                 size_mb: Column | None = None) -> DataFrame:
    """Sizes within inclusive bounds in MB; an unknown size is left out once a bound is set."""
    size = parse_size_mb(F.col("size_text")) if size_mb is None else size_mb
    if minimum is not None:
        df = df.filter(size >= F.lit(float(minimum)))
    if maximum is not None:
        df = df.filter(size <= F.lit(float(maximum)))
    return df


def bytes_between(df: DataFrame, column: str, minimum_mb: float | None, maximum_mb: float | None) -> DataFrame:
    """The file variant; the bounds become whole bytes, so that the scan can use them."""
    if minimum_mb is not None:
        df = df.filter(F.col(column) >= F.lit(math.ceil(minimum_mb * 1024 * 1024)))
    if maximum_mb is not None:
        df = df.filter(F.col(column) <= F.lit(math.floor(maximum_mb * 1024 * 1024)))
    return df


def active_only(df: DataFrame, column: str = "active") -> DataFrame:
    return df.filter(F.col(column))


def lookup_items(df: DataFrame, key: str, label: str) -> DataFrame:
    """Lookup rows for a selection list, sorted by label."""
    return df.select(F.col(key).alias("id"), F.col(label).alias("label")).orderBy("label", "id")


def servable(df: DataFrame, route: str, viewer: Viewer = ANONYMOUS) -> DataFrame:
    """Datasets a route may serve: ``public``, ``private``, ``hub`` (notebook hub) or ``export``."""
    unlocked = df.filter(~F.coalesce(F.col("locked"), F.lit(False)))
    if route == "export":
        return visible_to(unlocked.filter(F.col("allow_download")), viewer)
    offered = unlocked.filter(F.col("allow_api"))
    if route == "public":
        return offered.filter(F.col("visibility") == PUBLIC)
    if route == "private":
        return visible_to(offered, viewer)
    if route == "hub":
        seen = visible_to(offered, viewer)
        if viewer.role_id == ADMINISTRATOR:
            return seen
        if viewer.role_id == EDITOR and viewer.user_id is not None:
            return seen.filter(F.col("owner_id") == viewer.user_id)
        return seen.filter(F.lit(False))
    raise RequestError(f"unknown route {route}")


def star(datasets: DataFrame, users: DataFrame, organisations: DataFrame, licences: DataFrame,
         sites: DataFrame, visibilities: DataFrame, energy_types: DataFrame) -> DataFrame:
    """Datasets with all their labels; a missing dimension row leaves NULLs."""
    def side(df: DataFrame, key: str, **names: str) -> DataFrame:
        return lookup_side(df.select(F.col("id").alias(key), *[F.col(c).alias(a) for c, a in names.items()]))

    return (
        with_owner(datasets, users)
        .join(side(organisations, "owner_org_id", name="owner_org_name"), "owner_org_id", "left")
        .join(side(licences, "licence_id", label="licence"), "licence_id", "left")
        .join(side(sites, "site_id", name="site"), "site_id", "left")
        .join(side(visibilities, "visibility", label="visibility_label"), "visibility", "left")
        .join(side(energy_types, "energy_type_id", label="energy_type"), "energy_type_id", "left")
    )


def star_files(files: DataFrame, users: DataFrame, organisations: DataFrame, licences: DataFrame,
               visibilities: DataFrame) -> DataFrame:
    """Stored files with licence, visibility, owner and organisation labels."""
    return (
        with_owner(files, users)
        .join(lookup_side(organisations.select(F.col("id").alias("owner_org_id"), F.col("name").alias("owner_org_name"))),
              "owner_org_id", "left")
        .join(lookup_side(licences.select(F.col("id").alias("licence_id"), F.col("label").alias("licence"))),
              "licence_id", "left")
        .join(lookup_side(visibilities.select(F.col("id").alias("visibility"), F.col("label").alias("visibility_label"))),
              "visibility", "left")
    )


def dataset_sections(datasets: DataFrame, sections: DataFrame) -> DataFrame:
    """Datasets with the table names of their three sections side by side.

    A dataset has at most one section of each type, so the grouping is bounded.
    """
    def named(kind: str) -> Column:
        return F.max(F.when(F.col("section_type") == kind, F.col("table_name")))

    wide = sections.groupBy("dataset_id").agg(
        named("donnees").alias("main_table"), named("donnees_event_logs").alias("event_logs_table"),
        named("donnees_contexte_environnemental").alias("context_table"))
    return datasets.join(wide, datasets["id"] == wide["dataset_id"], "left").drop("dataset_id")


def dataset_devices(datasets: DataFrame, bridge: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per (dataset, device); kept flat, as a dataset may have any number of devices."""
    return (
        datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
        .join(bridge.select("dataset_id", "device_id"), "dataset_id")
        .join(devices.select(F.col("id").alias("device_id"), F.col("name").alias("device_name"),
                             "manufacturer", "model"), "device_id")
    )


def facets(visible: DataFrame) -> DataFrame:
    """Distinct creators, visibilities and organisations of the visible rows.

    One aggregation over all three lists: each row is spread to its three facet keys and combined
    before the shuffle.
    """
    def entry(kind: str, key: str, label: str) -> Column:
        return F.struct(F.lit(kind).alias("facet"), F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"))

    rows = visible.select(F.explode(F.array(
        entry("creator", "owner_id", "owner_name"),
        entry("organisation", "owner_org_id", "owner_org_name"),
        entry("visibility", "visibility", "visibility_label"))).alias("f")).select("f.*")
    # An owner or organisation that does not exist is no facet.
    return rows.filter(F.col("label").isNotNull()).distinct()


def latest_datasets(visible: DataFrame, n: int = 6) -> DataFrame:
    """Most recently updated first, never updated last, ties by id."""
    return visible.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(n)


def index_jobs(sections: DataFrame, datasets: DataFrame, status: str | None = None, text: str | None = None,
               section_type: str | None = None, owner_id: int | None = None) -> DataFrame:
    """Index state of all sections, failed ones first, then by dataset name."""
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("_name"),
                            F.col("owner_id").alias("_owner"))
    rows = search(filter_optional(sections, index_status=status, section_type=section_type),
                  text, ["label", "table_name"]).join(named, "dataset_id", "left")
    if owner_id is not None:
        rows = rows.filter(F.col("_owner") == owner_id)
    jobs = rows.select(
        "dataset_id", "section_type", F.coalesce("_name", "label").alias("dataset_name"), "table_name",
        F.coalesce("index_name", F.lit("")).alias("index_name"),
        F.coalesce("index_status", F.lit(NOT_ENABLED)).alias("index_status"),
        "index_time", "index_id", "index_include")
    return jobs.orderBy((F.col("index_status") == FAILED).desc(), "dataset_name", "dataset_id", "section_type")


def union_sections(main: DataFrame, event_logs: DataFrame, context: DataFrame) -> DataFrame:
    """The three section tables as one, with their type."""
    parts = [df.withColumn("section_type", F.lit(kind)) for df, kind in (
        (main, "donnees"), (event_logs, "donnees_event_logs"), (context, "donnees_contexte_environnemental"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
