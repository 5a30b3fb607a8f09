"""Running quotas in generations, sessions that are merged before the shuffle."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quayside.operators.usage import token_windows
from quayside.storage import names_in
from quayside.streaming import quotas as Q
from quayside.streaming.generations import generations, merge_batch, open_state

START = dt.datetime(2024, 1, 1)
LOG = "token_id long, accessed_at timestamp, bytes long"
MINUTES, DELAY = 10, 5


def log_rows(seed, count, hours):
    draw = random.Random(seed)
    at = sorted(START + dt.timedelta(seconds=draw.randint(0, hours * 3600)) for _ in range(count))
    # A third of all calls are one token's; some rows have none; some come a little late.
    rows = [(draw.choice([1, draw.randint(2, 6), None if draw.random() < 0.2 else 3]), t, draw.randint(1, 100)) for t in at]
    for i in range(0, len(rows) - 3, 7):
        rows[i], rows[i + 2] = rows[i + 2], rows[i]
    return rows


def windows(df):
    return sorted((r["token_id"], r["window_start"], r["window_end"], r["events"], r["bytes"]) for r in df.collect())


def written(spark, folder, rows, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def stream_of(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def test_generations_of_a_stream(spark, tmp_path):
    rows = log_rows(1, 400, 12)
    folder, path = str(tmp_path / "log"), str(tmp_path / "state")
    written(spark, folder, rows, 5)
    Q.run_token_slots(stream_of(spark, folder), path, str(tmp_path / "cp"), MINUTES, DELAY).awaitTermination()
    wanted = windows(token_windows(spark.createDataFrame(rows, LOG), minutes=MINUTES))
    assert windows(Q.live_token_windows(spark, path, minutes=MINUTES)) == wanted
    assert len(generations(spark, path)) <= 2
    # What is over has left the state, which a quota check reads alone.
    open_now = windows(Q.open_token_windows(spark, path, minutes=MINUTES))
    assert set(open_now) < set(wanted) and 0 < len(open_now) < len(wanted) / 3
    # More of the log, by the same query.
    later = [(t, at + dt.timedelta(hours=12), b) for t, at, b in log_rows(2, 60, 3)]
    spark.createDataFrame(later, LOG).coalesce(1).write.parquet(f"{folder}/later")
    Q.run_token_slots(stream_of(spark, folder), path, str(tmp_path / "cp"), MINUTES, DELAY).awaitTermination()
    assert windows(Q.live_token_windows(spark, path, minutes=MINUTES)) == windows(token_windows(spark.createDataFrame(rows + later, LOG), minutes=MINUTES))


def updates(rows, per_batch):
    """What a stream in update mode sends: slots that changed, without rows later than the watermark of the batch before."""
    slots, late, newest, out, taken = {}, dt.datetime.min, None, [], []
    for i in range(0, len(rows), per_batch):
        changed = set()
        for token, at, size in rows[i : i + per_batch]:
            slot = at - dt.timedelta(minutes=at.minute % MINUTES, seconds=at.second)
            if token is None or slot + dt.timedelta(minutes=MINUTES) <= late:
                continue
            taken.append((token, at, size))
            n, first, last, total = slots.get((token, slot), (0, at, at, 0))
            slots[token, slot] = (n + 1, min(first, at), max(last, at), total + size)
            changed.add((token, slot))
        if newest:
            late = newest - dt.timedelta(minutes=DELAY)
        newest = max([newest or dt.datetime.min, *(at for _, at, _ in rows[i : i + per_batch])])
        out.append([(*k, *slots[k]) for k in sorted(changed)])
    return out, taken


def test_fifty_batches_leave_two_generations(spark, tmp_path):
    path = str(tmp_path / "state")
    batches, taken = updates(log_rows(3, 600, 20), 12)
    assert len(batches) == 50
    schema = Q.SLOTS.format(kind="long")
    settle, delay = Q.settled_slots(MINUTES), dt.timedelta(minutes=DELAY)

    def send(number):
        frame = spark.createDataFrame(batches[number], schema).coalesce(1)
        merge_batch(frame, number, path, ["token_id", "slot"], "last_at", delay, settle)

    for i in range(50):
        send(i)
        if i == 30:
            before = windows(Q.live_token_windows(spark, path, minutes=MINUTES))
            send(30)   # a batch that is sent again adds nothing
            assert windows(Q.live_token_windows(spark, path, minutes=MINUTES)) == before
    assert [g.batch for g in generations(spark, path)] == [48, 49]
    assert open_state(spark, path, schema).count() < 30
    assert windows(Q.live_token_windows(spark, path, minutes=MINUTES)) == windows(token_windows(spark.createDataFrame(taken, LOG), minutes=MINUTES))


def test_an_endless_run_takes_few_rows(spark, tmp_path):
    """A token that never pauses: its final slots become one row, and the bytes of the window stay whole."""
    path = str(tmp_path / "state")
    rows = [(1, START + dt.timedelta(minutes=3 * i), 1) for i in range(200)]
    batches, _ = updates(rows, 20)
    for i, batch in enumerate(batches):
        merge_batch(spark.createDataFrame(batch, Q.SLOTS.format(kind="long")).coalesce(1), i, path, ["token_id", "slot"], "last_at",
                    dt.timedelta(minutes=DELAY), Q.settled_slots(MINUTES))
    assert open_state(spark, path, Q.SLOTS.format(kind="long")).count() < 15
    assert windows(Q.open_token_windows(spark, path, minutes=MINUTES)) == [(1, START, rows[-1][1] + dt.timedelta(minutes=MINUTES), 200, 200)]


def test_days_leave_the_state(spark, tmp_path):
    rows = [(1, START + dt.timedelta(hours=5 * i), 10) for i in range(60)]
    folder, path = str(tmp_path / "log"), str(tmp_path / "state")
    written(spark, folder, rows, 4)
    Q.run_daily_quota(stream_of(spark, folder), path, str(tmp_path / "cp"), limit=50).awaitTermination()
    found = sorted((r["day"], r["requests"], r["bytes"], r["exceeded"]) for r in Q.daily_state(spark, path).collect())
    per_day = {}
    for _, at, size in rows:
        n, total = per_day.get(at.date(), (0, 0))
        per_day[at.date()] = (n + 1, total + size)
    assert found == [(dt.datetime.combine(d, dt.time()), n, b, b >= 50) for d, (n, b) in sorted(per_day.items())]
    assert open_state(spark, path, Q.DAYS).count() <= 5 and len(names_in(spark, f"{path}/open")) <= 2


@pytest.mark.parametrize("merged", [True, False])
def test_a_hot_token_is_merged_before_the_shuffle(spark, tmp_path, merged):
    rows = log_rows(5, 300, 6)
    folder, path = str(tmp_path / "log"), str(tmp_path / "out")
    written(spark, folder, rows, 2)
    stream = Q.token_quota_stream(stream_of(spark, folder), minutes=MINUTES, delay=f"{DELAY} minutes")
    if merged:
        run = Q.append_to(stream, path, str(tmp_path / "cp"))
    else:
        run = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    text = run._jsq.explainInternal(False)
    below = text[re.search(r"Exchange hashpartitioning\(token_id", text).end() :]
    assert ("MergingSessions" in below) == merged
    found = windows(spark.read.parquet(path))
    every = windows(token_windows(spark.createDataFrame([r for r in rows if r[0] is not None], LOG), minutes=MINUTES))
    last = max(r[1] for r in rows) - dt.timedelta(minutes=DELAY)
    assert set(found) <= set(every) and {w for w in every if w[2] <= last - dt.timedelta(minutes=MINUTES)} <= set(found)
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "false"
