"""Leases, the expiry of many sessions, and index jobs."""

from __future__ import annotations

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from quayside.errors import StateError
from quayside.leases import Leases
from quayside.operators import replace as R
from quayside.operators.index_jobs import CLAIM, IndexRunner
from quayside.operators.slices import IndexColumns, slice_rows
from quayside.sources.tables import create_external, quoted, table_location, table_properties
from quayside.storage import names_in

HOUR = dt.timedelta(hours=1)


class Clock:
    def __init__(self):
        self.at = dt.datetime(2024, 1, 1)

    def __call__(self):
        return self.at


def at_once(count, act):
    """Results of ``act(i)`` in as many threads, all let go together."""
    gate, out = threading.Barrier(count), [None] * count

    def run(i):
        gate.wait()
        try:
            out[i] = act(i)
        except Exception as error:
            out[i] = error

    threads = [threading.Thread(target=run, args=(i,)) for i in range(count)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_of_many_takes_a_lease(spark, tmp_path):
    clock = Clock()
    leases = Leases(spark, str(tmp_path), clock)
    for i in range(100):
        won = at_once(4, lambda n: leases.acquire(f"d{i}", f"job{n}", HOUR))
        assert sorted(won) == [False, False, False, True]
    # The same when the lease before ran out.
    clock.at += 2 * HOUR
    for i in range(20):
        won = at_once(4, lambda n: leases.acquire(f"d{i}", f"later{n}", HOUR))
        assert won.count(True) == 1 and leases.holds(f"d{i}", f"later{won.index(True)}", HOUR)


def test_a_lease_over_time(spark, tmp_path):
    clock = Clock()
    leases = Leases(spark, str(tmp_path / "le ases"), clock)
    assert leases.latest("x") is None and not leases.holds("x", "a", HOUR) and not leases.release("x", "a")
    assert leases.acquire("x", "a", HOUR) and not leases.acquire("x", "b", HOUR) and leases.acquire("x", "a", HOUR)
    clock.at += 2 * HOUR
    assert leases.holds("x", "a", HOUR)                # nobody took it: renewed
    assert not leases.acquire("x", "b", HOUR)
    clock.at += 2 * HOUR
    assert leases.acquire("x", "b", HOUR) and not leases.holds("x", "a", HOUR) and not leases.release("x", "a")
    assert leases.release("x", "b") and leases.release("x", "b") and not leases.holds("x", "b", HOUR)
    assert leases.acquire("x", "c", HOUR)
    assert len(names_in(spark, str(tmp_path / "le ases" / "x"))) <= 4


@pytest.fixture
def source(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS lease")

    def make(rows=None):
        name, path = "t_" + uuid.uuid4().hex[:8], str(tmp_path / uuid.uuid4().hex)
        rows = rows if rows is not None else spark.range(3).withColumnRenamed("id", "n")
        rows.write.parquet(path)
        create_external(spark, f"lease.{name}", path, rows.schema)
        return name
    return make


def test_two_starts_at_once(spark, source, tmp_path):
    name = source()
    for i in range(3):
        replacers = [R.TableReplacer(spark, str(tmp_path / "r")) for _ in range(2)]
        found = at_once(2, lambda n: replacers[n].start(i, "lease", name))
        assert sorted(type(x).__name__ for x in found) == ["ReplaceSession", "StateError"]
    assert replacers[0].sessions().count() == 3


def test_a_session_that_lost_its_dataset_cannot_write(spark, source, tmp_path):
    name, clock = source(), Clock()
    replacer = R.TableReplacer(spark, str(tmp_path / "r"), clock)
    first = replacer.start(1, "lease", name)
    clock.at += 2 * HOUR
    second = replacer.start(1, "lease", name)
    assert replacer.load(first.id).status == R.ABORTED and replacer.load(second.id).status == R.STARTED
    with pytest.raises(StateError):
        replacer._record(first)
    with pytest.raises(StateError):
        replacer.start(1, "lease", name)
    with pytest.raises(StateError):
        replacer.start(2, "lease", "no_such_table")
    replacer.abort(second.id)
    assert replacer.start(1, "lease", name).status == R.STARTED


def test_a_thousand_expired_sessions_close_with_one_append(spark, source, tmp_path):
    name, clock = source(), Clock()
    replacer = R.TableReplacer(spark, str(tmp_path / "r"), clock)
    live = replacer.start(5000, "lease", name)
    replacer.append_chunk(live.id, spark.range(7).select(F.col("id").alias("n")))
    committed = replacer.commit(live.id)
    old = [R.ReplaceSession(f"s{i}", i, "lease", name, f"gone_{i}", str(tmp_path / f"gone{i}"), "", None, R.STARTED if i % 2 else R.UPLOADING, 0, None,
                            clock.at, revision=1) for i in range(1000)]
    spark.createDataFrame([tuple(vars(s).values()) for s in old], R.SESSION_SCHEMA).coalesce(1).write.mode("append").parquet(replacer.log_path)
    assert replacer.abort_expired() == 0
    clock.at += HOUR
    files = lambda: sum(x.endswith(".parquet") for x in names_in(spark, replacer.log_path))
    before = files()
    assert spark.table(f"lease.{name}").count() == 7
    assert replacer.abort_expired() == 1001 and files() == before + 1
    states = {r["id"]: (r["status"], r["revision"], r["completed_at"]) for r in replacer.sessions().collect()}
    assert states == {s.id: (R.ABORTED, 2, clock.at) for s in old} | {live.id: (R.ABORTED, committed.revision + 1, clock.at)}
    assert spark.table(f"lease.{name}").count() == 3       # the committed one got its old content back
    assert replacer.abort_expired() == 0 and replacer.start(1, "lease", name)


# -- index jobs

JOBS = "dataset_id long, section_type string, table_name string, index_enabled boolean, index_time string, index_id string, index_include string, index_name string, index_status string"


def jobs(spark, *rows):
    return spark.createDataFrame([(i, "lease", table, True, time, own, None, None, status) for i, table, time, own, status in rows], JOBS)


@pytest.fixture
def datasets(spark):
    return spark.range(1, 50).select("id", (F.col("id") == 9).alias("locked"))


def row_groups(spark, path):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names_in(spark, path):
        if name.endswith(".parquet"):
            file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
            for block in reader.getFooter().getBlocks():
                out.append({c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()} | {"rows": block.getRowCount()})
            reader.close()
    return out


def scanned(df):
    """Rows that the scans of a query hand on, after row groups were passed over."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_an_index_job_lets_a_slice_read_less(spark, source, datasets, tmp_path):
    # Ids in no order: every row group holds any of them.
    rows = spark.range(60_000).select(F.col("id").alias("k"), (F.hash("id") % 500).alias("device"),
                                      (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    name = source(rows.coalesce(1))
    runner = IndexRunner(spark, str(tmp_path / "r"), row_group_bytes=64 * 1024)
    index = IndexColumns(time="ts", key="k", id="device")
    wanted = sorted(map(tuple, rows.where("device = 77").collect()))
    before = slice_rows(spark.table(f"lease.{name}"), index, id_value="77")
    assert scanned(before) == 60_000
    found = runner.run_now(jobs(spark, (1, f"lease.{name}", "TS", "Device", "completed")), datasets, 1, "lease")
    assert found.status == "completed" and found.error is None
    after = slice_rows(spark.table(f"lease.{name}"), index, id_value="77")
    assert sorted(map(tuple, after.collect())) == wanted and scanned(after) < 10_000
    place = table_location(spark, f"lease.{name}")
    groups = row_groups(spark, place)
    assert len(groups) >= 4 and sum(g["rows"] for g in groups) == 60_000
    assert all(g["k"] < 0 for g in groups)
    # Ids that are too many for a dictionary get a Bloom filter.
    many = source(rows.withColumn("device", F.xxhash64("k")).coalesce(1))
    assert runner.run_now(jobs(spark, (2, f"lease.{many}", "ts", "device", "pending")), datasets, 2, "lease").status == "completed"
    assert all(g["device"] >= 0 and g["k"] < 0 for g in row_groups(spark, table_location(spark, f"lease.{many}")))
    # Again: the index is there, nothing is written. Then the folder from before goes.
    assert runner.run_now(jobs(spark, (1, f"lease.{name}", "ts", "device", None)), datasets, 1, "lease").status == "completed"
    assert table_location(spark, f"lease.{name}") == place
    assert runner.purge_old_layouts(f"lease.{name}") == 1 and runner.purge_old_layouts(f"lease.{name}") == 0
    assert spark.table(f"lease.{name}").count() == 60_000


def test_states_of_a_run(spark, source, datasets, tmp_path):
    clock = Clock()
    name, other = source(), source()
    runner = IndexRunner(spark, str(tmp_path / "r"), clock)
    sections = jobs(spark, (1, name, "n", None, "pending"), (2, f"lease.{other}", "missing", None, "pending"), (3, None, "n", None, "pending"),
                    (4, "lease.t", " ", None, "pending"), (5, "lease.nothing", "n", None, "pending"), (6, f"lease.{name}", "n", None, "pending"),
                    (7, f"lease.{name}", "n", None, "failed"), (9, f"lease.{name}", "n", None, "pending"))
    runner.leases.acquire(R.dataset_lease(6), "someone", HOUR)
    assert runner.run(sections, datasets) == {"completed": 1, "failed": 4, "pending": 1}
    states = {r["dataset_id"]: (r["index_status"], r["index_error"]) for r in runner.states(sections).collect()}
    assert states[1] == ("completed", None) and states[6] == states[9] == ("pending", None) and states[7] == ("failed", None)
    assert [states[i][0] for i in (2, 3, 4, 5)] == ["failed"] * 4 and "missing" in states[2][1] and "lease.nothing" in states[5][1]
    assert "quayside.index" in table_properties(spark, f"lease.{name}")
    # What was pending runs when its dataset is free; what failed does not run again by itself.
    clock.at += 2 * HOUR
    assert runner.run(sections, datasets) == {"completed": 1, "failed": 0, "pending": 0}
    assert runner.run(sections, datasets) == {"completed": 0, "failed": 0, "pending": 0}


def test_refusals_of_a_single_run(spark, source, datasets, tmp_path):
    clock = Clock()
    name = source()
    runner = IndexRunner(spark, str(tmp_path / "r"), clock)
    sections = jobs(spark, (1, name, "n", None, "completed"), (9, name, "n", None, "pending"))
    assert runner.run_now(sections, datasets, 8, "lease").error == "There is no such index job."
    assert runner.run_now(sections, datasets, 9, "lease").error == "The dataset is being replaced."
    off = sections.withColumn("index_enabled", F.lit(False))
    assert runner.run_now(off, datasets, 1, "lease").error == "The section has no index."
    # A runner that died while it had the claim.
    runner.leases.acquire(R.dataset_lease(1), "dead", CLAIM)
    runner._record({"dataset_id": 1, "section_type": "lease", "revision": 0}, 1, "running")
    assert runner.run_now(sections, datasets, 1, "lease").error == "The index job is running already."
    assert runner.states(sections).where("dataset_id = 1").head()["index_status"] == "running"
    clock.at += CLAIM
    assert runner.states(sections).where("dataset_id = 1").head()["index_status"] == "pending"
    assert runner.run_now(sections, datasets, 1, "lease").status == "completed"


def test_no_index_while_replacing_and_no_replace_while_indexing(spark, source, datasets, tmp_path):
    name = source()
    replacer, runner = R.TableReplacer(spark, str(tmp_path / "r")), IndexRunner(spark, str(tmp_path / "r"))
    sections = jobs(spark, (1, name, "n", None, "pending"))
    session = replacer.start(1, "lease", name)
    assert runner.run(sections, datasets)["pending"] == 1
    replacer.abort(session.id)
    runner.leases.acquire(R.dataset_lease(1), "index-x", CLAIM)
    with pytest.raises(StateError):
        replacer.start(1, "lease", name)
