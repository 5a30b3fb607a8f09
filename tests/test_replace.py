"""The replace cycle and its streaming form."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from quayside import types as L
from quayside.errors import InputError, StateError
from quayside.operators import replace as R
from quayside.operators.load import load_table
from quayside.sources.tables import table_exists
from quayside.sources.tabular import FILE_SEQ, ROW_NO
from quayside.streaming.ingest import stream_chunks


@pytest.fixture
def table(spark, tmp_path):
    """A loaded table with its key, and a replacer."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS rep")
    name = "t_" + uuid.uuid4().hex[:8]
    rows = spark.range(1, 6).select(F.col("id").cast("string").alias("n"), F.lit("old").alias("note"),
                                    F.lit(0).alias(FILE_SEQ), F.col("id").alias(ROW_NO))
    load_table(rows, [L.ColumnDef("n", L.INT), L.ColumnDef("note", L.TEXT, 255)], f"rep.{name}")
    return R.TableReplacer(spark, str(tmp_path / "replace")), name


def content(spark, name):
    return sorted((r["n"], r["note"]) for r in spark.table(f"rep.{name}").collect())


OLD = [(i, "old") for i in range(1, 6)]


def chunk(spark, folder, name, rows, schema="Note string, N string"):
    path = str(folder / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return [path]


def test_cycle(spark, table, tmp_path):
    replacer, name = table
    session = replacer.start(1, "rep", name)
    with pytest.raises(StateError):
        replacer.start(1, "rep", name)
    with pytest.raises(StateError):
        replacer.push(session.id)
    one = chunk(spark, tmp_path, "one", [("new", "1"), ("bad", "x"), (" ", "yes"), (None, None)])
    result, errors = replacer.append_chunk(session.id, one)
    assert (result.rows_read, result.rows_copied, result.empty_rows, result.errors) == (4, 2, 2, 2)
    assert sorted((r["row_number"], r["raw_value"], r["message"]) for r in errors.collect()) == [
        (2, "x", "Value must be an integer."), (3, "yes", "Value must be an integer.")]
    replacer.append_chunk(session.id, chunk(spark, tmp_path, "two", [("new", "2")]))
    replacer.append_chunk(session.id, one, chunk=1)
    with pytest.raises(InputError):
        replacer.append_chunk(session.id, chunk(spark, tmp_path, "three", [("x",)], "Note string"))
    assert content(spark, name) == OLD
    replacer.commit(session.id)
    wanted = sorted([(1, "new"), (2, "new")] + [(None, "bad")], key=str)
    assert sorted(((r["n"], r["note"]) for r in spark.table(f"rep.{name}").collect()), key=str) == wanted
    keys = [r["Id"] for r in spark.table(f"rep.{name}").collect()]
    assert len(set(keys)) == 3 and None not in keys
    with pytest.raises(StateError):
        replacer.append_chunk(session.id, one)
    audit = {r["column_name"]: r for r in replacer.audit(session.id).collect()}
    assert audit["n"]["non_null_delta"] == -3
    assert replacer.locked(1)
    assert replacer.push(session.id).status == R.PUSHED
    assert not replacer.locked(1) and not table_exists(spark, f"rep.{replacer.load(session.id).old_table}")
    assert spark.table(f"rep.{name}").count() == 3
    with pytest.raises(StateError):
        replacer.abort(session.id)


@pytest.mark.parametrize("committed", [True, False])
def test_abort_restores(spark, table, tmp_path, committed):
    replacer, name = table
    session = replacer.start(2, "rep", name)
    replacer.append_chunk(session.id, chunk(spark, tmp_path, "c", [("new", "9")]))
    if committed:
        replacer.commit(session.id)
        assert content(spark, name) == [(9, "new")]
    assert replacer.abort(session.id).status == R.ABORTED
    assert content(spark, name) == OLD
    assert not table_exists(spark, f"rep.{session.staging_table}")
    again = replacer.start(2, "rep", name)
    replacer.commit(again.id)
    assert content(spark, name) == []
    replacer.abort(again.id)
    assert content(spark, name) == OLD


def test_expired_sessions_are_aborted(spark, table, tmp_path):
    replacer, name = table
    clock = [dt.datetime(2024, 1, 1, 10)]
    replacer = R.TableReplacer(spark, str(tmp_path / "timed"), lambda: clock[0])
    session = replacer.start(3, "rep", name)
    replacer.commit(session.id)
    clock[0] += dt.timedelta(minutes=59)
    assert replacer.abort_expired() == 0
    clock[0] += dt.timedelta(minutes=1)
    assert replacer.abort_expired() == 1
    assert content(spark, name) == OLD


def test_interrupted_commit_is_finished(spark, table, tmp_path, monkeypatch):
    replacer, name = table
    session = replacer.start(4, "rep", name)
    replacer.append_chunk(session.id, chunk(spark, tmp_path, "c", [("new", "9")]))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(R, "point_to", broken)
        with pytest.raises(RuntimeError):
            replacer.commit(session.id)
    assert content(spark, name) == OLD
    assert replacer.recover(session.id).status == R.COMMITTED
    assert content(spark, name) == [(9, "new")]
    replacer.abort(session.id)
    assert content(spark, name) == OLD


@pytest.mark.parametrize("step", ["create_external", "point_to", "drop_table_if_exists", "_record"])
@pytest.mark.parametrize("then", ["recover", "commit", "abort"])
def test_commit_cut_at_any_step(spark, table, tmp_path, monkeypatch, step, then):
    replacer, name = table
    session = replacer.start(4, "rep", name)
    replacer.append_chunk(session.id, chunk(spark, tmp_path, "c", [("new", "9")]))
    calls = []

    def broken(*args, **named):
        calls.append(1)
        if step != "_record" or len(calls) == 2:   # the intent is recorded, the state is not
            raise RuntimeError("lost")
        return kept(*args, **named)

    holder = replacer if step == "_record" else R
    kept = getattr(holder, step)
    with monkeypatch.context() as patch:
        patch.setattr(holder, step, broken)
        with pytest.raises(RuntimeError):
            replacer.commit(session.id)
    with pytest.raises(StateError):
        replacer.append_chunk(session.id, chunk(spark, tmp_path, "late", [("late", "1")]))
    getattr(replacer, then)(session.id)
    if then != "abort":
        assert content(spark, name) == [(9, "new")]
        assert replacer.push(session.id).status == R.PUSHED
        assert content(spark, name) == [(9, "new")]
    else:
        assert content(spark, name) == OLD
    left = [x.name for x in spark.catalog.listTables("rep") if x.name.startswith(name + "__")]
    assert not left


def test_keys_fit_the_type_of_the_source(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS rep")
    name, path = "k_" + uuid.uuid4().hex[:8], str(tmp_path / "it's here")
    spark.sql("SELECT CAST(id AS INT) AS Id, 'old' AS note FROM range(1, 4)").write.parquet(path)
    R.create_external(spark, f"rep.{name}", path, spark.read.parquet(path).schema, {R.KEY_PROPERTY: "Id"})
    replacer = R.TableReplacer(spark, str(tmp_path / "replace it's"))
    session = replacer.start(6, "rep", name)
    for number in (1, 40_000, 1):
        rows = spark.createDataFrame([("new",)] * 3, "note string")
        replacer.append_chunk(session.id, rows, chunk=number)
    replacer.commit(session.id)
    found = spark.table(f"rep.{name}")
    assert dict(found.dtypes)["Id"] == "int" and found.count() == 6 and found.select("Id").distinct().count() == 6


def test_locks_follow_the_sessions(spark, table):
    replacer, name = table
    datasets = spark.createDataFrame([(1, False), (2, True), (3, None)], "id long, locked boolean")
    session = replacer.start(1, "rep", name)
    state = lambda: {r["id"]: r["locked"] for r in R.with_locks(datasets, replacer.sessions()).collect()}
    assert state() == {1: True, 2: True, 3: False}
    replacer.abort(session.id)
    assert state() == {1: False, 2: True, 3: False}


def test_refused_load_leaves_the_folder(spark, tmp_path):
    path = str(tmp_path / "mine")
    spark.range(3).write.parquet(path)
    rows = spark.createDataFrame([("x",)], "n string")
    for mode in ("fail", "null"):
        with pytest.raises(InputError):
            load_table(rows, [L.ColumnDef("n", L.INT)], "rep.never", on_errors=mode, path=path)
    assert spark.read.parquet(path).count() == 3


def test_state_rules():
    every = range(5)
    allowed = {(a, b) for a in every for b in every if R.allowed_transition(a, b)}
    assert allowed == {(0, 1), (1, 1), (0, 2), (1, 2), (2, 4), (0, 3), (1, 3), (2, 3)}


def test_stream_adds_each_chunk_once(spark, table, tmp_path):
    replacer, name = table
    session = replacer.start(5, "rep", name)
    folder = tmp_path / "incoming"
    rows = spark.createDataFrame([("new", str(i)) for i in range(30)], "note string, n string")
    rows.repartition(3).write.parquet(str(folder))
    stream_chunks(replacer, session.id, str(folder), rows.schema, str(tmp_path / "cp"), 1).awaitTermination()
    assert replacer.staged(session.id).count() == 30
    # Nothing new, and then the same files once more after the checkpoint was lost.
    stream_chunks(replacer, session.id, str(folder), rows.schema, str(tmp_path / "cp"), 1).awaitTermination()
    stream_chunks(replacer, session.id, str(folder), rows.schema, str(tmp_path / "cp2"), 1).awaitTermination()
    assert replacer.staged(session.id).count() == 30
    keys = replacer.staged(session.id).select("Id").distinct().count()
    assert keys == 30
