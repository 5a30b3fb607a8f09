"""Dense indexes and CSV exports."""

from __future__ import annotations

import csv
import glob
import json

import pytest

from pyspark.sql import functions as F

from quayside.errors import InputError
from quayside.operators.rowindex import add_surrogate_key, row_index, row_index_by_location, surrogate_key_name
from quayside.sources.export import checked_rows, export_csv_parts, export_table, warnings_report
from quayside.sources.tables import create_external


def test_hot_key_is_spread(spark):
    rows = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 != 1, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    indexed = row_index(rows, ["k", "id"])
    found = [r["row_index"] for r in indexed.orderBy("k", "id").collect()]
    assert found == list(range(1, 6001))


def test_unordered_index_is_dense(spark):
    found = sorted(r["row_index"] for r in row_index(spark.range(0, 1000, 1, 7)).collect())
    assert found == list(range(1, 1001))
    assert row_index(spark.range(0), ["id"]).count() == 0


def test_index_by_location(spark, monkeypatch):
    monkeypatch.setattr("quayside.operators.rowindex.BLOCK_ROWS", 10)
    rows = spark.range(0, 200, 1, 5).select((F.col("id") % 2).alias("f"), (F.col("id") * 3).alias("r"))
    found = row_index_by_location(rows, ["f"], "r").orderBy("f", "r").collect()
    assert [r["row_index"] for r in found] == list(range(1, 201))


def test_key_names(spark):
    assert surrogate_key_name(["a", "ID"]) == "MyPK_id" and surrogate_key_name(["a"]) == "Id"
    keyed = add_surrogate_key(spark.range(0, 50, 1, 4).toDF("x"), dense=False)
    assert keyed.columns == ["Id", "x"] and keyed.select("Id").distinct().count() == 50


def parts_of(path):
    return sorted(glob.glob(f"{path}/part=*/*.csv"), key=lambda p: int(p.split("part=")[1].split("/")[0]))


def test_parts_cover_the_table(spark, tmp_path):
    path = str(tmp_path / "out")
    hostile = ['a"b', "a,b", "line\nbreak", "cr\rhere", " padded ", "", "#x", "\\", '"', "é"]
    rows = spark.range(0, 25, 1, 3).select("id", F.element_at(F.array(*[F.lit(h) for h in hostile]), (F.col("id") % 10 + 1).cast("int")).alias("t"))
    manifest = export_csv_parts(rows, path, 10, ["id"], {"section": "data"})
    assert (manifest["totalRowCount"], manifest["maxRowsPerPart"], manifest["section"]) == (25, 10, "data")
    files = parts_of(path)
    assert len(files) == 3
    found = []
    for file in files:
        with open(file, newline="", encoding="utf-8") as handle:
            header, *body = list(csv.reader(handle))
        assert header == ["id", "t"]
        found.append(body)
    assert [len(b) for b in found] == [10, 10, 5]
    assert [row for body in found for row in body] == [[str(i), hostile[i % 10]] for i in range(25)]
    listed = sorted(json.loads(line)["part_number"] for f in glob.glob(f"{path}/_manifest_parts/*.json") for line in open(f))
    assert listed == [1, 2, 3]


def test_empty_table_gives_a_header(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert export_csv_parts(spark.createDataFrame([], "a int, b string"), path)["totalRowCount"] == 0
    files = parts_of(path)
    assert len(files) == 1 and open(files[0]).read().strip() == "a,b"


def test_limits(spark):
    assert checked_rows(10) == 10
    for wrong in (0, 9_000_000):
        with pytest.raises(InputError):
            checked_rows(wrong)
    warnings = spark.range(150).select(F.col("id").alias("row_index"), F.lit("c").alias("column_name"))
    shown, cut = warnings_report(warnings)
    assert shown.count() == 100 and cut


def test_table_export_in_stored_order(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "out")
    spark.range(0, 40, 1, 4).write.parquet(source)
    spark.sql("CREATE SCHEMA IF NOT EXISTS exports")
    create_external(spark, "exports.t", source, spark.read.parquet(source).schema)
    manifest = export_table(spark, "exports.t", path, 15)
    assert (manifest["totalRowCount"], manifest["table"]) == (40, "exports.t")
    bodies = [open(f).read().split()[1:] for f in parts_of(path)]
    assert [len(b) for b in bodies] == [15, 15, 10] and sorted(int(v) for b in bodies for v in b) == list(range(40))
