"""Visibility invariants, guards with odd data, and windows against brute force."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.errors import RequestError
from quayside.operators import catalog as C
from quayside.operators import guards as G
from quayside.operators import usage as U
from quayside.plans.portal_tables import Portal
from quayside.sources.tables import resolve_table, split_name


@pytest.fixture(scope="module")
def portal(spark, folder):
    return Portal(spark, folder)


def seen(rows, viewer):
    return {r["id"] for r in C.visible_to(rows, viewer).select("id").collect()}


def test_visibility_grows_with_the_role(portal):
    rows = C.with_owner(portal.datasets(), portal.users())
    anonymous = seen(rows, C.ANONYMOUS)
    observer = seen(rows, C.Viewer(7, C.OBSERVER, 5))
    member = seen(rows, C.Viewer(7, C.USER, 5))
    admin = seen(rows, C.Viewer(7, C.ADMINISTRATOR, 5))
    assert anonymous < observer < member < admin
    assert admin == {r["id"] for r in rows.select("id").collect()}
    assert seen(rows, C.Viewer(7, C.EDITOR, None)) == observer


def test_decisions_match_single_viewers(portal, spark):
    users = portal.users().orderBy("id").limit(8).collect()
    ids = [r["id"] for r in portal.datasets().select("id").orderBy("id").limit(40).collect()]
    requests = spark.createDataFrame([(d, u["id"]) for d in ids for u in users] + [(ids[0], None), (-1, users[0]["id"])],
                                     "dataset_id long, user_id long")
    decided = {(r["dataset_id"], r["user_id"]) for r in C.access_decisions(requests, portal.datasets(), portal.users()).collect() if r["allowed"]}
    rows = C.with_owner(portal.datasets(), portal.users()).filter(F.col("id").isin(ids))
    wanted = {(d, u["id"]) for u in users for d in seen(rows, C.Viewer(u["id"], u["role_id"], u["org_id"]))}
    assert {p for p in decided if p[1] is not None} == wanted
    assert all(d >= 0 for d, _ in decided)


def test_routes(portal):
    with pytest.raises(RequestError):
        C.servable(portal.datasets(), "ftp")
    assert C.servable(portal.datasets(), "hub", C.Viewer(7, C.USER, 5)).count() == 0


def test_domains_with_odd_addresses(spark):
    domains = spark.createDataFrame([(1, 1, "a.org"), (2, 1, "x@a.org"), (3, 2, "a.org"), (4, 1, "org")], "id int, org_id int, domain string")
    users = spark.createDataFrame([(1, "me@x@a.org"), (2, "me@b.org"), (1, None), (1, "none")], "org_id int, email string")
    used = G.domains_in_use(domains, users, users.limit(0))
    assert sorted(r["id"] for r in used.collect()) == [1, 2]


def test_next_code(spark):
    day = dt.date(2024, 1, 31)
    sections = spark.createDataFrame([(" Wind ", "2024010109"), ("wind", "2023010199"), ("sun", None)], "label string, code string")
    assert G.next_code(sections, "WIND", day) == "20240131100"
    assert G.next_code(sections, "sun", day) == "2024013101"
    assert G.next_code(sections, "new", day) == G.next_code(sections, " ", day) == "2024013101"


def brute_windows(events, gap):
    runs = {}
    for key, at, size in sorted(events):
        mine = runs.setdefault(key, [])
        if mine and at <= mine[-1][1] + gap:
            mine[-1][1], mine[-1][2], mine[-1][3] = at, mine[-1][2] + 1, mine[-1][3] + size
        else:
            mine.append([at, at, 1, size])
    return sorted((k, first, last + gap, n, s) for k, mine in runs.items() for first, last, n, s in mine)


def test_windows_extend_across_midnight_and_at_the_exact_gap(spark):
    start, gap = dt.datetime(2024, 1, 1, 22), dt.timedelta(minutes=60)
    steps = [0, 60, 59, 61, 60, 1, 0, 60, 60, 60, 60, 200, 60, 60]
    events, at = [], start
    for i, minutes in enumerate(steps):
        at += dt.timedelta(minutes=minutes)
        events += [(1, at, i), (2, at + dt.timedelta(seconds=i * 7), 1)]
    log = spark.createDataFrame(events + [(None, start, 5)], "token_id long, accessed_at timestamp_ntz, bytes long")
    found = sorted(tuple(r) for r in U.token_windows(log, limit=6).drop("exceeded").collect())
    assert found == brute_windows(events, gap)
    flags = {r["bytes"]: r["exceeded"] for r in U.token_windows(log, limit=6).collect()}
    assert all(flag == (size >= 6) for size, flag in flags.items())


def test_attempts_are_counted_per_lowercase_key(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("A@x", at), ("a@X", at), ("a@x", at)], "k string, at timestamp_ntz")
    row = U.attempt_windows(log, "k", "at", 2, 10).head()
    assert (row["k"], row["events"], row["limited"]) == ("a@x", 3, True)


def test_table_names(spark):
    sections = spark.createDataFrame([("donnees.Abc",), ("abc",), ("other",)], "table_name string")
    assert resolve_table(sections, "ABC").count() == 2 and resolve_table(sections, "donnees.abc").count() == 1
    assert split_name("DONNEES.x", "f") == ("DONNEES", "x") and split_name("a.b", "f") == ("f", "a.b")


def test_lookup_side_is_counted_when_its_size_is_unknown(spark, portal, monkeypatch):
    from quayside import storage

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or \
            "UnresolvedHint" in df._jdf.queryExecution().logical().toString()

    made = spark.createDataFrame([(i, "x") for i in range(5)], "id int, label string")
    assert storage.source_bytes(made) is None and hinted(storage.lookup_side(made))
    assert storage.source_bytes(portal.energy_types()) is not None and not hinted(storage.lookup_side(portal.energy_types()))
    monkeypatch.setattr(storage, "LOOKUP_ROWS", 3)
    assert not hinted(storage.lookup_side(made))


def test_no_limit_is_never_used_up(portal):
    assert not any(r["exceeded"] for r in U.daily_quota(portal.access_log(), limit=0).collect())
    assert all(r["exceeded"] for r in U.daily_quota(portal.access_log(), limit=1).collect())
