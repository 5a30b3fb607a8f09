"""Many files, bounded pages, folders of a job, profiles that add up."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quayside import types as L
from quayside.errors import InputError, RequestError
from quayside.operators import replace as R
from quayside.operators.load import load_table
from quayside.operators.profile import profile
from quayside.operators.sketches import merged_profile, sketch, sketch_schema
from quayside.plans import catalogue_of_queries
from quayside.sources.export import export_csv_parts
from quayside.sources.footers import parquet_schemas
from quayside.sources.pages import most_bytes, write_page_parquet
from quayside.sources.tables import create_external
from quayside.sources.tabular import FILE_SEQ, read_parquet
from quayside.storage import fresh_path, job_folders, materialise, names_in, path_exists, shared_dir


# -- schemas

def parquet_files(folder, count, start=0):
    os.makedirs(folder, exist_ok=True)
    for i in range(start, start + count):
        pq.write_table(pa.table({"n": pa.array([i, i + 1], pa.int64()), " t ": pa.array(["a", "b"])}), f"{folder}/f{i:04d}.parquet")
    return [f"{folder}/f{i:04d}.parquet" for i in range(start, start + count)]


def test_schemas_of_many_files_take_one_job_per_kind(spark, tmp_path):
    few, many = parquet_files(str(tmp_path / "few"), 10), parquet_files(str(tmp_path / "many"), 1000)
    times = {}
    for name, paths in (("few", few), ("few again", few), ("many", many)):
        at = time.time()
        found = parquet_schemas(spark, paths)
        times[name] = time.time() - at
        assert len({id(x) for x in found}) == 1 and found[0].names == ["n", " t "]
    rows = read_parquet(spark, many)
    assert rows.count() == 2000 and rows.select(FILE_SEQ).distinct().count() == 1000
    print(times)


def test_mixed_files_and_folders(spark, tmp_path):
    paths = parquet_files(str(tmp_path / "a"), 2)
    other = str(tmp_path / "b.parquet")
    spark.createDataFrame([("7", "x")], "N string, T string").coalesce(1).write.parquet(other)   # a folder, other types
    found = read_parquet(spark, [*paths, other, paths[0]])
    assert sorted((r["n"], r[FILE_SEQ]) for r in found.collect()) == [("0", 0), ("0", 3), ("1", 0), ("1", 1), ("1", 3), ("2", 1), ("7", 2)]
    pq.write_table(pa.table({"n": [1], "other": ["x"]}), str(tmp_path / "c.parquet"))
    with pytest.raises(InputError):
        read_parquet(spark, [paths[0], str(tmp_path / "c.parquet")])
    (tmp_path / "no.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        read_parquet(spark, [paths[0], str(tmp_path / "no.parquet")])


# -- pages

def test_a_page_is_one_file_of_row_groups(spark, tmp_path):
    page = spark.range(2500).select("id", F.concat(F.lit("text "), "id").alias("t"), F.array("id").alias("a"))
    size = write_page_parquet(page, str(tmp_path / "page"), 1000)
    files = [x for x in names_in(spark, str(tmp_path / "page")) if x.endswith(".parquet")]
    meta = pq.ParquetFile(str(tmp_path / "page" / files[0])).metadata
    assert len(files) == 1 and [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]
    assert 0 < size <= most_bytes(page, 1000)
    empty = spark.range(0)
    assert 0 < write_page_parquet(empty, str(tmp_path / "empty"), 10) <= most_bytes(empty, 10)


def test_the_bound_of_a_page_holds(spark, tmp_path):
    for i, page in enumerate((
            spark.range(50).select(F.xxhash64("id").alias("h"), F.sha2(F.col("id").cast("string"), 512).alias("s"), F.lit(None).cast("string").alias("z")),
            spark.range(3).select(F.repeat(F.lit("é"), 5000).alias("s"), F.struct("id", F.col("id").cast("decimal(38,12)").alias("d")).alias("st"),
                                  F.create_map("id", F.lit("m")).alias("m"), F.lit(dt.datetime(2024, 1, 1)).alias("at"), F.lit(True).alias("b")))):
        assert write_page_parquet(page, str(tmp_path / f"p{i}"), 7) <= most_bytes(page, 7)


def test_a_refused_page_writes_nothing(spark, tmp_path):
    page = spark.range(5000).select(F.xxhash64("id").alias("h"))
    with pytest.raises(RequestError):
        write_page_parquet(page, str(tmp_path / "no"), 1000, max_bytes=10_000)
    assert names_in(spark, str(tmp_path)) == []
    # More than the limit by the bound, but not when it is compressed.
    same = spark.range(5000).select(F.lit("the same long text in every row of the page").alias("t"))
    assert write_page_parquet(same, str(tmp_path / "yes"), 10_000, max_bytes=20_000) <= 20_000 < most_bytes(same, 10_000)
    assert names_in(spark, str(tmp_path)) == ["yes"] and spark.read.parquet(str(tmp_path / "yes")).count() == 5000


# -- folders

def test_folders_go_with_their_job(spark):
    with job_folders(spark) as job:
        a, b = fresh_path(spark, "a"), job.keep(fresh_path(spark, "b"))
        kept = materialise(spark.range(3), "c", keep=True)
        gone = materialise(spark.range(3), "d")
        for path in (a, b):
            spark.range(1).write.parquet(path)
        with job_folders(spark):
            inner = materialise(spark.range(2), "e").count()
    assert inner == 2 and not path_exists(spark, a) and path_exists(spark, b) and kept.count() == 3
    assert not any(path_exists(spark, x) for x in gone.inputFiles())
    with pytest.raises(ValueError), job_folders(spark) as job:
        path = job.keep(fresh_path(spark, "f"))
        spark.range(1).write.parquet(path)
        raise ValueError
    assert not path_exists(spark, path)


def test_jobs_leave_nothing_behind(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("n"))
    columns = [L.ColumnDef("n", L.INT)]
    spark.sql("CREATE SCHEMA IF NOT EXISTS lifecycle")
    # (folders from other tests may lie there)
    before = set(names_in(spark, shared_dir(spark)))
    fresh = lambda: sorted(x.rsplit("-", 1)[0] for x in set(names_in(spark, shared_dir(spark))) - before)
    load_table(rows, columns, "lifecycle.t")
    assert fresh() == ["rejects", "table-lifecycle-t"]
    load_table(rows, columns, "lifecycle.t", purge=True)
    assert fresh() == ["rejects", "rejects", "table-lifecycle-t"] and spark.table("lifecycle.t").count() == 20
    with pytest.raises(Exception):
        load_table(rows.withColumn("n", F.lit("x")), columns, "lifecycle.t")
    replacer = R.TableReplacer(spark, str(tmp_path / "r"))
    session = replacer.start(1, "lifecycle", "t")
    replacer.append_chunk(session.id, rows)
    export_csv_parts(rows, str(tmp_path / "csv"), 7, ["n"])
    assert fresh() == ["rejects", "rejects", "table-lifecycle-t"]
    assert spark.table("lifecycle.t").count() == 20 and replacer.staged(session.id).count() == 20


# -- profiles that add up

def test_merged_profiles_equal_those_of_the_whole(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("far", F.col("value") + 1e9).withColumn(
        "day", F.col("ts").cast("date")).withColumn("none", F.lit(None).cast("int")).withColumn("flag", F.col("event_id") % 2 == 0)
    parts = [events.where(F.col("event_id") % 7 == i) for i in range(7)] + [events.limit(0)]
    stored = sketch(parts[0])
    for part in parts[1:]:
        stored = stored.unionByName(sketch(part))
    assert [(f.name, f.dataType.simpleString()) for f in stored.schema] == [(f.name, f.dataType.simpleString()) for f in sketch_schema(events.schema)]
    merged = {r["column_name"]: r for r in merged_profile(stored, events.schema).collect()}
    for whole in profile(events).collect():
        found = merged[whole["column_name"]]
        for field in whole.asDict():
            if field == "unique_count":
                assert abs(found[field] - whole[field]) <= 0.05 * whole[field], whole["column_name"]
            elif isinstance(whole[field], float):
                assert math.isclose(found[field], whole[field], rel_tol=1e-9), (whole["column_name"], field)
            else:
                assert found[field] == whole[field], (whole["column_name"], field)


def test_an_audit_from_chunks_reads_no_table(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS audit")
    spark.sql("DROP TABLE IF EXISTS audit.t")
    path = str(tmp_path / "source")
    spark.range(100).select(F.col("id").alias("n"), (F.col("id") / 4).alias("v")).write.parquet(path)
    create_external(spark, "audit.t", path, spark.read.parquet(path).schema)
    replacer = R.TableReplacer(spark, str(tmp_path / "r"))

    def replaced(shift):
        session = replacer.start(1, "audit", "t")
        for number in (1, 2, 1):   # the first one is sent again
            half = spark.range(100).where(F.col("id") % 2 == number - 1).select((F.col("id") / 4 + shift).alias("V"), F.col("id").alias("N"))
            replacer.append_chunk(session.id, half, chunk=number)
        replacer.commit(session.id)
        return session.id

    first = replaced(1.0)
    columns = ("column_name", "unique_delta", "non_null_delta", "avg_delta")
    exact = lambda rows: sorted(tuple(r[c] for c in columns) for r in rows.collect())
    assert exact(replacer.audit_from_sketches(first)) == exact(replacer.audit(first))
    replacer.push(first)
    second = replaced(3.0)
    audit = replacer.audit_from_sketches(second)
    assert exact(audit) == exact(replacer.audit(second))
    read = " ".join(audit.inputFiles())
    assert "/_sketches/" in read and "/chunk-" in read and "staging" not in read and path not in read
    replacer.abort(second)
    assert not names_in(spark, f"{replacer.root}/_sketches/{second}") and names_in(spark, f"{replacer.root}/_sketches/{first}")


# -- content hashes

def test_small_files_are_written_by_all_tasks(spark, tmp_path):
    """One task that writes a file per row takes as long as there are rows; a repeated key is one file."""
    rows = [(i, f"name {i}") for i in range(60)] + [(7, "name 7")]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    before = {x for x in os.listdir(shared_dir(spark)) if x.startswith("supplier-files")}
    found = {x.s_suppkey: x.sha256 for x in catalogue_of_queries()[0]["content_hashes_of_files"](spark, str(tmp_path)).collect()}
    text = {i: f"name {i}\n" for i in range(60)} | {7: "name 7\n" * 2}
    assert found == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in text.items()}
    folder, = {x for x in os.listdir(shared_dir(spark)) if x.startswith("supplier-files")} - before
    parts = [x.name.split("-")[1] for x in Path(shared_dir(spark), folder).rglob("part-*.txt")]
    assert len(parts) == 60 and len(set(parts)) > 1
