"""Checks before records are created, renamed or deleted, and the related reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import email_domain, suffix_number
from quayside.operators.catalog import ADMINISTRATOR, PENDING

# State of an account request that waits for a decision.
REQUEST_PENDING = 1


def normal_name(name: Column) -> Column:
    return F.lower(F.btrim(name))


def duplicate_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Names used more than once, ignoring case and surrounding blanks."""
    return df.groupBy(normal_name(F.col(name)).alias("normal_name")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")


def name_conflicts(df: DataFrame, name: str = "name") -> DataFrame:
    """All records of a repeated name. The groups come first, so no pairs are formed."""
    repeated = duplicate_names(df, name)
    return df.join(repeated, normal_name(df[name]) == repeated["normal_name"], "left_semi")


def name_taken(df: DataFrame, text: str, own_id: int | None = None, name: str = "name") -> DataFrame:
    """Records, other than the own one, that already use a name."""
    rows = df.filter(normal_name(F.col(name)) == text.strip().lower())
    return rows if own_id is None else rows.filter(F.col("id") != own_id)


def _email_suffixes(people: DataFrame) -> DataFrame:
    """Distinct (organisation, text after an ``@``): one per address, more only for odd addresses."""
    parts = F.size(F.split("email", "@")) - 1
    ends = F.transform(
        F.when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(F.split("email", "@"), -i, i), "@"))
    return people.select("org_id", F.explode(ends).alias("suffix")).distinct()


def domains_in_use(domains: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Domains with a user or request of the same organisation whose address ends with them.

    ``ends with '@' + domain`` is the same as ``the text after some '@' equals the domain``, so an
    equi-join on organisation and suffix decides it; a large organisation is spread by suffix.
    """
    used = _email_suffixes(users.select("org_id", "email")).union(
        _email_suffixes(requests.select("org_id", "email")))
    return domains.join(
        used, (domains["org_id"] == used["org_id"]) & (domains["domain"] == used["suffix"]), "left_semi")


def deletable_organisations(organisations: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Organisations without users and without requests."""
    members = users.select("org_id").union(requests.select("org_id")).distinct()
    return organisations.join(members, organisations["id"] == members["org_id"], "left_anti")


def valid_domain_requests(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """Requests whose address lies in an active domain of their organisation, any case."""
    active = domains.filter("active").select(
        F.col("org_id").alias("_org"), F.lower("domain").alias("_domain")).distinct()
    return requests.join(
        active, (requests["org_id"] == F.col("_org"))
        & (F.lower(email_domain(requests["email"])) == F.col("_domain")), "left_semi")


def pending_verified(requests: DataFrame) -> DataFrame:
    """Requests that wait for a decision and whose address is verified."""
    return requests.filter((F.col("status_id") == REQUEST_PENDING) & F.col("email_verified"))


def active_administrators(users: DataFrame) -> DataFrame:
    return users.filter((F.col("role_id") == ADMINISTRATOR) & F.col("active"))


def pending_index_jobs(sections: DataFrame, datasets: DataFrame) -> DataFrame:
    """Sections waiting for their index whose dataset is not being replaced."""
    locked = datasets.filter("locked").select(F.col("id").alias("_locked"))
    waiting = sections.filter(F.col("index_enabled") & (F.col("index_status") == PENDING))
    return waiting.join(locked, waiting["dataset_id"] == locked["_locked"], "left_anti")


def delete_datasets(ids: DataFrame, datasets: DataFrame, sections: DataFrame,
                    bridge: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once the given datasets are gone. Locked datasets stay."""
    doomed = ids.select(F.col("id").alias("_id")).distinct().join(
        datasets.filter(~F.coalesce(F.col("locked"), F.lit(False))).select("id"), F.col("_id") == F.col("id"),
        "left_semi")

    def without(df: DataFrame, key: str) -> DataFrame:
        return df.join(doomed, df[key] == doomed["_id"], "left_anti")

    return {"datasets": without(datasets, "id"), "sections": without(sections, "dataset_id"),
            "bridge": without(bridge, "dataset_id")}


def next_codes(sections: DataFrame, day: dt.date) -> DataFrame:
    """Next free code of every label: the date and the highest two-digit suffix plus one."""
    prefix = day.strftime("%Y%m%d")
    numbered = sections.filter(F.btrim("label") != "").groupBy(normal_name(F.col("label")).alias("label")).agg(
        (F.coalesce(F.max(suffix_number(F.col("code"))), F.lit(0)) + 1).alias("next_number"))
    text = F.col("next_number").cast("string")
    return numbered.select("label", "next_number", F.concat(
        F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))).alias("next_code"))


def next_code(sections: DataFrame, label: str, day: dt.date) -> str:
    """Next code of one label; a label never used starts at 01."""
    first = day.strftime("%Y%m%d") + "01"
    if not label or not label.strip():
        return first
    row = next_codes(sections.filter(normal_name(F.col("label")) == label.strip().lower()), day).head()
    return row["next_code"] if row else first


def latest_message(messages: DataFrame, time: str = "updated_at", key: str = "id") -> DataFrame:
    """The message changed last."""
    return messages.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()).limit(1)
