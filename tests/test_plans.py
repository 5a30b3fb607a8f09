"""Plans: what reaches the scan, what is shuffled, and what must not appear."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quayside.functions.literals import cursor_encode
from quayside.operators.infer import inference_report
from quayside.operators.profile import profile
from quayside.operators.slices import IndexColumns, include_slice, keyset_page, slice_rows
from quayside.operators.convert import convert
from quayside.plans.ingest import COLUMNS, NAMES, raw_cells
from quayside.plans.portal_tables import Portal

INDEX = IndexColumns(time="ts", key="event_id", id="user_id", include="value")


def plan(df, mode: str = "formatted") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet")


def test_slices_are_pushed_down_and_pruned(events):
    text = plan(include_slice(events, INDEX, "12.31", "2024-01-05", "2024-01-20", "7"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text)[1]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed and "EqualTo(user_id,7)" in pushed
    assert "EqualTo(value,12.31)" in pushed
    assert "props" not in re.search(r"ReadSchema: (.*)", text)[1] and "Exchange" not in text


def test_pages_use_top_k(events):
    text = plan(keyset_page(slice_rows(events, INDEX, "2024-01-05"), INDEX.order(), 100, cursor_encode([7, None, 5])))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "GreaterThanOrEqual(user_id,7)" in text


def test_profile_reads_each_column_once_per_part(events):
    text = plan(profile(events))
    assert "Expand" not in text
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert sorted(len(s.split(",")) for s in schemas) == [1] * len(events.columns) + [len(events.columns)]
    approx = plan(profile(events, distinct="approx"))
    assert len(re.findall(r"\(\d+\) Scan parquet", approx)) == 1


def test_conversion_and_inference_stay_narrow(spark, folder):
    cells = raw_cells(Portal(spark, folder)).select(*NAMES)
    text = plan(convert(cells, COLUMNS))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("SinglePartition") == 0
    reduced = plan(inference_report(cells))
    assert reduced.count("Exchange") <= 4 and "partial_" in reduced


SINGLE_TASK_WINDOW = re.compile(r"Window.*\n(?:.*\n){0,6}?.*Exchange SinglePartition")


@pytest.mark.parametrize("name", [n for n in contract.queries() if n.split("_")[0] not in ("replace", "stream", "load", "read", "export")])
def test_no_cross_joins_no_python_rows(name, spark, folder):
    rows = contract.queries()[name](spark, folder)
    text = plan(rows)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not SINGLE_TASK_WINDOW.search(plan(rows, "simple"))
