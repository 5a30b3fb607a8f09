"""URL filters as a temporal list join: dated list entries become validity intervals, and every capture is judged by
the entries that were active when it was fetched. DataFrame operations only.

A pattern without a slash names a domain and everything below it; with a slash it names a host and a path up to a
whole segment. A capture is looked up under its own possible patterns (an equi join, as deep as the list goes), and
the as-of condition is made an equi join as well: intervals are laid out over days, so a capture meets only the
intervals that touch its day. A hot pattern is split by day on both sides.

Cases: a capture without time or URL matches nothing and is ``undated`` or ``allowed``; of several entries of a
pattern at one instant the largest entry id counts; an entry without pattern, time or known action is void; repeated
captures are one row with their number in ``captures``; an empty list allows everything; further columns of either
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.storage import materialise

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def segments_of(url: Column) -> Column:
    """Path segments without empty ones."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")


def day_of(time: Column) -> Column:
    return F.unix_date(time.cast("date"))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to`` (null: still active) from ``entry_id, listed_at, pattern, action``.

    An entry holds until the next one of its pattern. The next one is looked for within the day first and then in
    the next day that has one, so no task sees more than a day of a pattern, or one row per day of it.
    """
    changes = entries.where("listed_at is not null and pattern <> '' and action in ('add', 'remove')").groupBy(
        "pattern", "listed_at").agg(F.max(F.struct("entry_id", "action"))["action"].alias("action"))
    changes = changes.withColumn("day", day_of(F.col("listed_at")))
    within = Window.partitionBy("pattern", "day").orderBy("listed_at")
    days = changes.groupBy("pattern", "day").agg(F.min("listed_at").alias("first_at"))
    days = days.select("pattern", "day", F.lead("first_at").over(Window.partitionBy("pattern").orderBy("day")).alias("after"))
    return changes.withColumn("following", F.lead("listed_at").over(within)).join(days, ["pattern", "day"]).where(
        "action = 'add'").select("pattern", F.col("listed_at").alias("valid_from"),
                                 F.coalesce("following", "after").alias("valid_to"))


def patterns_of(url: Column, labels: int, depth: int) -> Column:
    """The patterns that can match a URL: its domain and parents, its host with path prefixes."""
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    none = F.array().cast("array<string>")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
                          lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n))) if labels else none
    path = segments_of(url)
    reach = F.least(F.size(path), F.lit(depth))
    prefixes = F.when(reach > 0, F.transform(F.sequence(F.lit(1), reach),
                      lambda n: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(path, 1, n)))))
    return F.when(host != "", F.concat(domains, F.coalesce(prefixes, none)))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched_at, captures, verdict, n_rules, rule, listed_at`` of ``captures(page_id, url,
    fetched_at)``; rule is the longest active pattern."""
    listed = materialise(validity(entries), "list-validity")
    labels, depth = listed.agg(
        F.max(F.when(~F.col("pattern").contains("/"), F.size(F.split("pattern", r"\.")))),
        F.max(F.size(F.split("pattern", "/")) - 1)).first()
    last = captures.agg(F.max("fetched_at")).first()[0]
    until = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    spans = listed.where(F.col("valid_from") <= F.lit(last)).select("*", F.explode(F.sequence(
        day_of(F.col("valid_from")), day_of(until))).alias("day"))
    asked = captures.select("page_id", "url", "fetched_at", F.posexplode_outer(
        patterns_of(F.col("url"), labels or 0, depth or 0) if labels or depth else F.array(F.lit(""))).alias("n", "asked"))
    asked = asked.withColumn("asked_day", day_of(F.col("fetched_at")))
    met = asked.join(spans, (F.col("asked") == F.col("pattern")) & (F.col("asked_day") == F.col("day"))
                     & (F.col("fetched_at") >= F.col("valid_from"))
                     & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))), "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("l"), "pattern", "valid_from")))
    return met.groupBy("page_id", "url", "fetched_at").agg(
        F.sum(F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(0)).alias("captures"),
        F.count("pattern").alias("hits"), best.alias("best"),
    ).select(
        "page_id", "url", "fetched_at", "captures",
        F.when(F.col("fetched_at").isNull(), "undated").when(F.col("hits") > 0, "blocked").otherwise("allowed").alias("verdict"),
        (F.col("hits") / F.col("captures")).cast("long").alias("n_rules"),
        F.col("best.pattern").alias("rule"), F.col("best.valid_from").alias("listed_at"))


def dated_entries(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A dated list drawn from the given tables: an ``error`` event lists the page its user stands for, a ``signup``
    event clears it; the event id says whether the host, the host with its first path segment, or the full path."""
    sites = pages.where("page_id is not null").groupBy("page_id").agg(F.min("url").alias("url"))
    sites = sites.select("page_id", host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("path"))
    reports = events.where("event_type in ('error', 'signup')")
    whole = F.concat_ws("/", F.array(F.col("host")), F.col("path"))
    first = F.concat_ws("/", F.array(F.col("host")), F.slice("path", 1, 1))
    return reports.join(sites, reports["user_id"] == sites["page_id"]).select(
        F.col("event_id").alias("entry_id"), F.col("ts").alias("listed_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("host")).when(F.col("event_id") % 3 == 1, first).otherwise(whole).alias("pattern"),
        F.when(F.col("event_type") == "error", "add").otherwise("remove").alias("action"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, which have no fetch time: the id spreads them over the 30 days of the events."""
    seconds = F.expr("make_dt_interval(0, 0, 0, pmod(page_id * 7919, 2592000))")
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + seconds).alias("fetched_at"))


ORACLE = r"""
WITH pages_ AS (
  SELECT page_id, url,
         TIMESTAMP '2024-01-01' + to_seconds(((page_id * 7919) % 2592000)::BIGINT) AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
         [x FOR x IN string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/') IF x <> ''] AS path
  FROM pages),
entries AS (
  SELECT e.event_id AS entry_id, e.ts AS listed_at, e.event_type = 'error' AS adds,
         CASE e.event_id % 3 WHEN 0 THEN p.host
              WHEN 1 THEN array_to_string(list_concat([p.host], p.path[1:1]), '/')
              ELSE array_to_string(list_concat([p.host], p.path), '/') END AS pattern
  FROM events e JOIN (SELECT DISTINCT ON (page_id) page_id, host, path FROM pages_ WHERE page_id IS NOT NULL
                      ORDER BY page_id, url) p ON e.user_id = p.page_id
  WHERE e.event_type IN ('error', 'signup')),
changes AS (
  SELECT pattern, listed_at, arg_max(adds, entry_id) AS adds FROM entries
  WHERE pattern <> '' AND listed_at IS NOT NULL GROUP BY ALL),
intervals AS (
  SELECT pattern, adds, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to
  FROM changes),
active AS (SELECT * FROM intervals WHERE adds),
asked AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
           [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
           [host || '/' || array_to_string(path[1:i], '/') FOR i IN range(1, len(path) + 1)])) AS pattern
  FROM pages_ WHERE host <> ''),
hits AS (
  SELECT a.page_id, a.url, a.fetched_at, a.pattern, v.valid_from
  FROM asked a JOIN active v ON a.pattern = v.pattern AND a.fetched_at >= v.valid_from
       AND (v.valid_to IS NULL OR a.fetched_at < v.valid_to)),
best AS (
  SELECT page_id, url, fetched_at, count(*) AS n_rules,
         max({'l': length(pattern), 'p': pattern, 'f': valid_from}) AS b FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, c.captures,
       CASE WHEN c.fetched_at IS NULL THEN 'undated' WHEN b.n_rules > 0 THEN 'blocked' ELSE 'allowed' END AS verdict,
       coalesce(b.n_rules, 0) AS n_rules, b.b.p AS rule, b.b.f AS listed_at
FROM (SELECT page_id, url, fetched_at, count(*) AS captures FROM pages_ GROUP BY ALL) c
LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url
     AND c.fetched_at IS NOT DISTINCT FROM b.fetched_at
"""
