from pyspark.sql import functions as F

from newsweave.session import scratch_path
from newsweave.sources import sinks
from newsweave.streaming import jobs, tables
from newsweave.streaming.triggers import TriggeredRuns, refresh_due, run_reason


def test_thresholds():
    assert run_reason(49, 0) is None and run_reason(50, 0) == "rows"
    assert run_reason(1, 1799) is None and run_reason(1, 1800) == "time"
    assert run_reason(0, 9999) is None and run_reason(0, 0, force=True) == "forced"
    assert not refresh_due(199) and refresh_due(200)


def batch(spark, start, n):
    return spark.range(start, start + n).withColumnRenamed("id", "k")


def test_runs_wait_for_rows_or_time_and_survive_a_replay(spark):
    path, now, handled, refreshed = scratch_path(spark, "t"), [0.0], {}, []
    runs = TriggeredRuns(
        path, "k BIGINT", lambda rows, b: handled.__setitem__(b, rows.count()), refreshed.append, clock=lambda: now[0]
    )
    runs(batch(spark, 0, 49), 0)
    assert handled == {}
    runs(batch(spark, 49, 1), 1)  # 50 rows wait
    assert handled == {1: 50} and refreshed == [1]
    runs(batch(spark, 50, 1), 2)
    now[0] = 1799.0
    runs(batch(spark, 51, 0), 3)
    assert handled == {1: 50}
    now[0] = 1800.0
    runs(batch(spark, 51, 0), 4)  # one row, waited long enough
    assert handled[4] == 1 and refreshed == [1]
    runs(batch(spark, 51, 198), 5)  # 1 + 198 since the refresh
    assert handled[5] == 198 and refreshed == [1]
    runs(batch(spark, 249, 50), 6)
    assert handled[6] == 50 and refreshed == [1, 6]
    again = TriggeredRuns(path, "k BIGINT", lambda rows, b: handled.__setitem__(b, rows.count()), clock=lambda: now[0])
    again(batch(spark, 249, 50), 6)  # a restarted stream repeats its last batch
    assert handled[6] == 50
    rows = {r["batch"]: r["reason"] for r in again.control(spark).collect()}
    assert rows == {0: None, 1: "rows", 2: None, 3: None, 4: "time", 5: "rows", 6: "rows"}


def test_upserts_are_replay_safe(spark):
    path = scratch_path(spark, "u")
    first = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k INT, t STRING, v DOUBLE")
    second = spark.createDataFrame([(1, None, 2.0), (3, "c", 3.0)], "k INT, t STRING, v DOUBLE")
    for number, rows in ((0, first), (1, second), (1, second)):
        tables.write_batch(rows, path, number)
    read = tables.read_batches(spark, path, "k INT, t STRING, v DOUBLE")
    assert {tuple(r) for r in tables.latest_fields(read, "k").collect()} == {(1, "a", 2.0), (2, "b", None), (3, "c", 3.0)}
    assert {tuple(r) for r in tables.latest_rows(read, "k").collect()} == {(1, None, 2.0), (2, "b", None), (3, "c", 3.0)}
    stored = sinks.upsert_set(first, second, "k")
    assert {(r["k"], r["t"], r["v"], r["change"]) for r in stored.collect()} == {
        (1, "a", 2.0, "update"), (2, "b", None, "keep"), (3, "c", 3.0, "insert"),
    }


def test_stream_in_several_batches_equals_batch(spark):
    path = scratch_path(spark, "s")
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("task"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"))
    rows.repartitionByRange(6, "id").write.parquet(f"{path}/in")
    stream = jobs.file_stream(spark, f"{path}/in", "id BIGINT, task BIGINT, ts TIMESTAMP", files_per_batch=2)
    volume = jobs.daily_volume(stream, "ts", None)
    jobs.start(jobs.batched(volume, f"{path}/out", "complete"), f"{path}/c").awaitTermination()
    out = tables.read_batches(spark, f"{path}/out", "day DATE, n BIGINT")
    assert out.select("batch").distinct().count() > 1
    want = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    assert tables.latest_rows(out, "day").exceptAll(want).count() == 0
    tasks = jobs.live_tasks(jobs.file_stream(spark, f"{path}/in", "id BIGINT, task BIGINT, ts TIMESTAMP", 2), "task", "ts", "id")
    jobs.start(jobs.batched(tasks, f"{path}/tasks", "update"), f"{path}/c2").awaitTermination()
    latest = tables.latest_rows(
        tables.read_batches(spark, f"{path}/tasks", "task BIGINT, status BIGINT, started_at TIMESTAMP, ended_at TIMESTAMP, line_count BIGINT"), "task"
    )
    assert {(r["task"], r["line_count"]) for r in latest.collect()} == {(t, len(range(t, 1000, 7))) for t in range(7)}


def test_scratch_reset(spark):
    path = scratch_path(spark, "r")
    rows = batch(spark, 0, 5)
    rows.write.parquet(path)
    sinks.reset_table(spark, rows, path)
    assert spark.read.schema("k BIGINT").parquet(path).count() == 0


def test_arriving_batches_are_equal_whatever_the_keys(spark, monkeypatch):
    from newsweave.plans import stream_queries

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 3)
    path, seen = scratch_path(spark, "arriving"), {}
    keys = [(n * n,) for n in range(51)]  # far from evenly spread
    stream = stream_queries.arriving(spark, spark.createDataFrame(keys, "k BIGINT"), f"{path}/in", "k")
    stream_queries.finish(jobs.for_each_batch(stream, lambda rows, b: seen.__setitem__(b, sorted(r[0] for r in rows.collect()))), f"{path}/checkpoint")
    assert [len(seen[b]) for b in sorted(seen)] == [10, 10, 10, 10, 11]
    assert [k for b in sorted(seen) for k in seen[b]] == [n * n for n in range(51)]


def test_waiting_ends_when_micro_batches_follow_each_other_without_a_pause():
    import time

    from newsweave.streaming import runs

    class Busy:
        isActive, status, stopped = True, {"isTriggerActive": True}, False
        started = time.monotonic()

        @property
        def lastProgress(self):
            return {"batchId": int((time.monotonic() - self.started) / 0.3)}

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    query = Busy()
    runs.wait_for(query, lambda: True, seconds=10)
    assert query.stopped and time.monotonic() - query.started < 5
