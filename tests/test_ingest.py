"""Files with hostile content, end to end."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from quayside import types as L
from quayside.errors import InputError
from quayside.operators.convert import accept_gate, convert, displayed_errors, drop_empty_rows, import_errors
from quayside.operators.infer import infer_columns, infer_files
from quayside.operators.load import load_table
from quayside.sources.tables import describe_columns, table_exists
from quayside.sources.tabular import FILE_SEQ, ROW_NO, data_columns, detect_format, head_rows, read_csv, read_tabular


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_bytes(content.encode(encoding))
    return str(path)


def inferred(rows, sample=None):
    return [(c.name, c.logical) for c in infer_columns(rows, data_columns(rows), sample, (FILE_SEQ, ROW_NO))]


def test_types(spark, tmp_path):
    path = write(tmp_path, "types.csv", (
        "flag, when ,n,big,amount,ratio,note\n"
        "true,2024-01-05,1,3000000000,1.5,1e40,hello\n"
        "no,1/2/2024,-2,4,\"1,000.25\",2,\n"))
    assert inferred(read_tabular(spark, [path])) == [
        ("flag", L.BIT), ("when", L.DATE_TIME), ("n", L.INT), ("big", L.BIG_INT), ("amount", L.DECIMAL),
        ("ratio", L.FLOAT), ("note", L.TEXT)]


def test_precedence(spark, tmp_path):
    path = write(tmp_path, "p.csv", "zero_one,year,none\n0,2024,\n1,2025, \n")
    assert inferred(read_csv(spark, [path])) == [("zero_one", L.BIT), ("year", L.INT), ("none", L.TEXT)]


def test_sample_takes_first_rows_in_file_order(spark, tmp_path):
    first = write(tmp_path, "a.csv", "n\n" + "".join(f"{i}\n" for i in range(2, 30)))
    second = write(tmp_path, "b.csv", "N\n" + "x\n" * 5)
    rows = read_csv(spark, [first, second])
    assert inferred(rows, 28) == [("n", L.INT)]
    assert inferred(rows, 29) == [("n", L.TEXT)]
    assert inferred(rows) == [("n", L.TEXT)]


@pytest.mark.parametrize("multiline", [True, False])
def test_row_numbers_and_rejects(spark, tmp_path, multiline):
    path = write(tmp_path, "bad.csv", "\n  \nn,note\n1,a\n\nx,b\n , \n,\n4,d\ny,\n")
    rows = read_csv(spark, [path], multiline)
    assert [(r["n"], r[ROW_NO]) for r in rows.orderBy(ROW_NO).collect()] == [
        ("1", 1), ("x", 2), (" ", 3), (None, 4), ("4", 5), ("y", 6)]
    columns = [L.ColumnDef("n", L.INT), L.ColumnDef("note", L.TEXT, 255)]
    typed = convert(rows, columns)
    errors = [tuple(r) for r in displayed_errors(import_errors(typed)).collect()]
    assert errors == [("bad.csv", 2, "n", "x", "Cannot convert value to int; stored as NULL."),
                      ("bad.csv", 6, "n", "y", "Cannot convert value to int; stored as NULL.")]
    kept = drop_empty_rows(typed, ["n", "note"]).orderBy(ROW_NO).collect()
    assert [(r["n"], r["note"], r[ROW_NO]) for r in kept] == [(1, "a", 1), (None, "b", 2), (4, "d", 5)]


def test_quoted_fields(spark, tmp_path):
    path = write(tmp_path, "quoted.csv", 'a,b\n"x, ""y""\nz"," keep "\n"",last\n')
    rows = read_csv(spark, [path]).orderBy(ROW_NO).collect()
    assert [(r["a"], r["b"]) for r in rows] == [('x, "y"\nz', " keep "), (None, "last")]


@pytest.mark.parametrize("content", ["a,b\n1\n", "a,b\n1,2,3\n", "a,b\n1,2\n3\n"])
@pytest.mark.parametrize("multiline", [True, False])
def test_ragged_rows_are_refused(spark, tmp_path, content, multiline):
    with pytest.raises(InputError, match="number of header columns"):
        read_csv(spark, [write(tmp_path, "ragged.csv", content)], multiline)


def test_headers_of_several_files(spark, tmp_path):
    a = write(tmp_path, "a.csv", "Id,Name\n1,x\n")
    b = write(tmp_path, "b.csv", "﻿ID, name \n2,y\n")
    c = write(tmp_path, "c.csv", "Name,Id\nz,3\n")
    both = read_csv(spark, [a, b]).orderBy("Id").collect()
    assert [(r["Id"], r["Name"], r["_file"], r[ROW_NO]) for r in both] == [("1", "x", "a.csv", 1), ("2", "y", "b.csv", 1)]
    with pytest.raises(InputError, match="same columns"):
        read_csv(spark, [a, c])
    with pytest.raises(InputError, match="unique"):
        read_csv(spark, [write(tmp_path, "dup.csv", "A,a\n1,2\n")])


def test_formats(tmp_path):
    assert detect_format(["x.CSV"]) == ".csv" and detect_format(["a.csv.zip", "b.CSV.ZIP"]) == ".csv.zip"
    for paths in ([], ["a.csv", "b.parquet"], ["a.xlsx"], ["a.zip"]):
        with pytest.raises(InputError):
            detect_format(paths)


def zipped(folder, name, entries):
    path = folder / name
    with zipfile.ZipFile(path, "w") as archive:
        for entry, content in entries.items():
            archive.writestr(entry, content)
    return str(path)


def test_zipped_csv(spark, tmp_path):
    path = zipped(tmp_path, "two.csv.zip", {
        "one.csv": 'a,b\n1,"x\ny"\n\n2,z\n', "readme.txt": "no", "sub/two.CSV": " A ,b\n3,w\n"})
    rows = read_tabular(spark, [path]).orderBy("a").collect()
    assert [(r["a"], r["b"], r["_file"], r[ROW_NO]) for r in rows] == [
        ("1", "x\ny", "two.csv.zip/one.csv", 1), ("2", "z", "two.csv.zip/one.csv", 2), ("3", "w", "two.csv.zip/sub/two.CSV", 1)]
    with pytest.raises(InputError, match="same columns"):
        read_tabular(spark, [zipped(tmp_path, "other.csv.zip", {"a.csv": "a\n1\n", "b.csv": "b\n1\n"})])
    with pytest.raises(InputError, match="number of header columns"):
        read_tabular(spark, [zipped(tmp_path, "ragged.csv.zip", {"a.csv": "a,b\n1\n"})])
    with pytest.raises(Exception, match="at least one CSV"):
        read_tabular(spark, [zipped(tmp_path, "none.csv.zip", {"a.txt": "x"})])


def test_parquet_leaves_and_mixed_types(spark, tmp_path):
    one, two = str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet")
    spark.range(3).select(F.col("id").alias("N"), F.struct(F.lit("x").alias(" inner ")).alias("s")).coalesce(1).write.parquet(one)
    spark.createDataFrame([(7.5, ("y",))], "n double, s struct<inner:string>").coalesce(1).write.parquet(two)
    rows = read_tabular(spark, [one, two])
    assert data_columns(rows) == ["N", "inner"]
    assert sorted((r["N"], r["inner"], r[FILE_SEQ], r[ROW_NO]) for r in rows.collect()) == [
        ("0", "x", 0, 1), ("1", "x", 0, 2), ("2", "x", 0, 3), ("7.5", "y", 1, 1)]
    nested = str(tmp_path / "nested.parquet")
    spark.range(1).select(F.array("id").alias("a")).write.parquet(nested)
    with pytest.raises(InputError, match="lists or maps"):
        read_tabular(spark, [nested])


def test_long_text(spark, tmp_path):
    path = write(tmp_path, "long.csv", "a,b,c\n" + "x" * 5000 + "," + "y" * 300 + ",z\n")
    assert [(c.length, c.sql_type) for c in infer_columns(read_csv(spark, [path]), ["a", "b", "c"])] == [
        (5000, "NVARCHAR(MAX)"), (300, "NVARCHAR(300)"), (255, "NVARCHAR(255)")]


@pytest.mark.parametrize("dense", [True, False])
def test_load_table(spark, tmp_path, dense):
    path = write(tmp_path, "load.csv", "ID,seen,n\n" + "".join(f"{i},2024-01-0{i % 9 + 1},{i}\n" for i in range(50))
                 + ",,\nx,y,z\n50,2024-02-30,7\n")
    rows = read_csv(spark, [path])
    columns = [L.ColumnDef("ID", L.INT), L.ColumnDef("seen", L.DATE_TIME), L.ColumnDef("n", L.INT)]
    table = f"loads.t_{'dense' if dense else 'sparse'}"
    with pytest.raises(InputError, match="could not be converted"):
        load_table(rows, columns, table, dense_key=dense)
    assert not table_exists(spark, table)
    result, rejects = load_table(rows, columns, table, on_errors="null", dense_key=dense)
    assert (result.rows_read, result.rows_copied, result.empty_rows, result.errors) == (53, 51, 2, 4)
    assert rejects.count() == 4
    loaded = spark.table(table)
    assert loaded.columns == ["MyPK_id", "ID", "seen", "n"]
    keys = [r["MyPK_id"] for r in loaded.orderBy("ID").collect()]
    assert keys == list(range(1, 52)) if dense else len(set(keys)) == 51
    assert loaded.filter("ID = 50").head()["seen"] is None
    assert loaded.filter("ID = 3").head()["seen"] == dt.datetime(2024, 1, 4)
    # A failed reload leaves the published table as it was.
    with pytest.raises(InputError):
        load_table(rows, columns, table, dense_key=dense)
    assert spark.table(table).count() == 51
    assert [r["data_type"] for r in describe_columns(loaded).orderBy("ordinal").collect()][1:] == ["int", "datetime2", "int"]


def test_gate():
    from quayside.operators.convert import ImportResult
    assert accept_gate(ImportResult(5, 4, 1, 2), "null").rows_copied == 4
    with pytest.raises(InputError):
        accept_gate(ImportResult(5, 4, 1, 2))


def test_head_rows_and_sampled_inference(spark, tmp_path):
    a = write(tmp_path, "a.csv", "\n N ,t\n" + "".join(f'{i},"x\ny"\n' for i in range(2, 12)))
    b = write(tmp_path, "b.csv", "n,T\nx,y\nz\n")
    assert [r["N"] for r in head_rows(spark, [a, b], 11).collect()] == [str(i) for i in range(2, 12)] + ["x"]
    assert [c.logical for c in infer_files(spark, [a, b], 10)] == [L.INT, L.TEXT]
    assert [c.logical for c in infer_files(spark, [a, b], 11)] == [L.TEXT, L.TEXT]
    with pytest.raises(InputError, match="number of header columns"):
        head_rows(spark, [a, b], 12)
    archive = zipped(tmp_path, "h.csv.zip", {"one.csv": "n,t\n1,a\n2,b\n", "two.csv": "n,t\n3,c\n"})
    assert [r["n"] for r in head_rows(spark, [archive], 3).collect()] == ["1", "2", "3"]
    parquet = str(tmp_path / "h.parquet")
    spark.range(5).coalesce(1).write.parquet(parquet)
    assert [r["id"] for r in head_rows(spark, [parquet], 3).collect()] == ["0", "1", "2"]
