from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from resamplia.operators import joins, ordered
from resamplia.operators.ordered import Ranges, dense_codes, find_ranges, running_totals
from resamplia.plans import monitor

SCHEMA = (
    "run long, pid long, time timestamp, pct_cpu double, parallel boolean, framework string, "
    "backend string, platform string, num_workers int, main_pid long"
)
START = dt.datetime(2024, 5, 1, 12, 59, 58)


def sample(run, pid, second, cpu=50.0, framework="future", platform="unix", main_pid=1):
    time = START + dt.timedelta(seconds=second)
    return (run, pid, time, cpu, True, framework, "mirai", platform, 8, main_pid)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_relative_time(spark):
    rows = [sample(1, 5, s) for s in (0, 1, 4)] + [sample(2, 5, 10)]
    rows += [sample(3, 5, s, platform=None) for s in (2, 4)]
    found = monitor.relative_time(table(spark, rows)).collect()
    times = sorted((r.run, r.time, r.rel_time) for r in found)
    assert [t[2] for t in times] == [0.0, 0.25, 1.0, None, 0.0, 1.0]
    assert len(found[0]) == len(SCHEMA.split(",")) + 1


def test_relative_time_with_a_hot_run_and_many_runs(spark, monkeypatch):
    """The same result when the limits are too many to broadcast."""
    ids = spark.range(3000)
    run = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("bigint")
    rows = ids.select(
        run.alias("run"),
        F.timestamp_micros(F.lit(10**15) + F.col("id") * 12345).alias("time"),
        *[F.lit("x").alias(c) for c in ("framework", "backend", "platform")],
    )
    columns = ["run", "time", F.round("rel_time", 12).alias("rel_time")]
    broadcast = monitor.relative_time(rows).select(*columns)
    monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = monitor.relative_time(rows).select(*columns)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, broadcast.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unusual_processes(spark):
    values = [(2, 0, 251.0), (2, 1, 3.0), (3, 0, 0.5), (4, 0, 250.0), (5, 0, 1.0)]
    rows = [sample(1, *value) for value in values]
    df = table(spark, rows)
    found = monitor.unusual_processes(df)
    assert found.columns == ["run", "pid", "framework", "backend"]
    assert {r.pid for r in found.collect()} == {2, 3}
    assert {(r.pid, r.max_cpu, r.min_cpu) for r in monitor.cpu_range(df).collect() if r.pid == 2} == {(2, 251.0, 3.0)}


def test_worker_panel(spark):
    rows = [sample(4, pid, s) for pid in (30, 7, 1, 100) for s in (2, 0)]
    rows += [sample(5, 8, 0), sample(3, 8, 0, platform="macOS"), sample(2, 8, 0, framework="foreach")]
    panel = monitor.worker_panel(table(spark, rows), "future", "mirai", ["unix"]).collect()
    assert [(r.run, r.pid, r.code, r.worker, r.min_sec) for r in panel] == [
        (4, 7, 1, "worker process 1", "59:58"),
        (4, 7, 1, "worker process 1", "00:00"),
        (4, 30, 2, "worker process 2", "59:58"),
        (4, 30, 2, "worker process 2", "00:00"),
        (4, 100, 3, "worker process 3", "59:58"),
        (4, 100, 3, "worker process 3", "00:00"),
    ]
    every = monitor.worker_panel(table(spark, rows), "future", "mirai").collect()
    assert {r.run for r in every} == {3}


def test_worker_labels_have_one_width(spark):
    rows = [sample(1, 10 + pid, 0) for pid in range(11)]
    labels = [r.worker for r in monitor.worker_panel(table(spark, rows), "future", "mirai").collect()]
    assert labels[0] == "worker process  1" and labels[-1] == "worker process 11"


def test_panel_without_rows(spark):
    df = table(spark, [sample(1, 2, 0)])
    assert monitor.worker_panel(df, "future", "psock").count() == 0


def test_panel_labels(spark):
    rows = [sample(2, 5, s) for s in (0, 3)] + [sample(1, 5, 0), sample(1, 6, 1)]
    rows.append((1, 6, START + dt.timedelta(seconds=2.5), 1.0, True, "future", "mirai", "unix", 8, 1))
    found = monitor.panel_labels(table(spark, rows)).collect()
    assert [(r.run, r.total_seconds, r.title, r.x_label) for r in found] == [
        (1, 3, "future via mirai (unix)", "Time (min:sec)\ntotal time: 3s")
    ]


def test_single_run_leaves_out_the_main_process(spark):
    df = table(spark, [sample(3, 1, 0), sample(3, 2, 0), sample(4, 2, 0)])
    assert [r.pid for r in monitor.single_run(df, "future", 3).collect()] == [2]


def test_busy_and_idle(spark):
    values = [(2, 0, 90.0), (2, 1, 80.0), (3, 1, 70.0), (4, 1, 1.0), (4, 3600, 0.0), (1, 1, 99.0)]
    rows = [sample(1, *value) for value in values]  # process 1 is the main one
    busy = {(r.busy, r.samples) for r in monitor.busy_workers(table(spark, rows), "1 hour", 50.0).collect()}
    assert busy == {(2, 4), (0, 1)}
    idle = {r.pid: r.idle_share for r in monitor.idle_share(table(spark, rows), 5.0).collect()}
    assert idle == {2: 0.0, 3: 0.0, 4: 1.0}


@pytest.mark.parametrize("rows_per_range", [1_000_000, 1])
@pytest.mark.parametrize("kind", ["bigint", "double", "int"])
def test_running_totals(spark, kind, rows_per_range, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", rows_per_range)
    values = sorted({(i * 7919) % 5003 - 2000 for i in range(1500)})
    rows = spark.createDataFrame([(v, v % 17) for v in values], "key long, amount long").repartition(5)
    df = rows.withColumn("key", F.col("key").cast(kind))
    found = {r.key: r.amount_before for r in running_totals(df, "key", ["amount"]).collect()}
    total = 0
    for value in values:
        assert found[value] == total
        total += value % 17
    assert len(found) == len(values)


def test_workers_of_different_runs_are_different(spark):
    rows = [sample(run, 5, 0, 90.0) for run in (1, 2, 3)]
    assert monitor.busy_workers(table(spark, rows), "1 hour", 50.0).first().busy == 3
    assert monitor.idle_share(table(spark, rows), 5.0).count() == 3


def test_labels_of_a_panel_of_several_platforms(spark):
    rows = [sample(1, 5, s) for s in (0, 3)] + [sample(2, 6, s) for s in (0, 9)]
    rows.append((1, 6, START + dt.timedelta(seconds=4.5), 1.0, True, "future", "mirai", "macOS", 8, 1))
    found = monitor.labels_of_panel(table(spark, rows), "future", "mirai", ["unix", "macOS"]).collect()
    assert {(r.platform, r.run, r.total_seconds) for r in found} == {("unix", 1, 5), ("macOS", 1, 5)}
    every = monitor.labels_of_panel(table(spark, rows), "future", "mirai").collect()
    assert {(r.platform, r.total_seconds) for r in every} == {("unix", 5), ("macOS", 5)}
    assert monitor.labels_of_panel(table(spark, rows), "future", "none").count() == 0


def test_range_numbers_keep_the_order(spark):
    ranges = Ranges((0.0, 1.5, 7.0), ((-4.0, -2.0), (0.5,), tuple(2 + k / 10 for k in range(40)), (8.0, 9.0)))
    keys = spark.range(-60, 300).select((F.col("id") / 10).alias("key"))
    numbers = [r.n for r in keys.select("key", ranges.number("key").alias("n")).orderBy("key").collect()]
    assert numbers == sorted(numbers) and numbers[0] == 0
    assert len(set(numbers)) > 40


@pytest.mark.parametrize("kind", ["squares", "pareto", "infinite"])
def test_more_keys_give_more_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 10)
    u = (F.col("id") + 1) / 5001
    key = {"squares": (F.col("id") * F.col("id")).cast("double"), "pareto": F.pow(1 - u, F.lit(-3.0))}.get(kind, F.col("id").cast("double"))
    keys = spark.range(5000).select(key.alias("key"))
    if kind == "infinite":
        keys = keys.unionByName(spark.createDataFrame([(float("inf"),), (float("-inf"),)], "key double"))
    ranges = find_ranges(keys, "key")
    sizes = [r["count"] for r in keys.groupBy(ranges.number("key").alias("n")).count().collect()]
    assert len(sizes) > 400 and max(sizes) <= 20


def test_dense_codes(spark):
    df = spark.createDataFrame([(p,) for p in (900, 5, 5, 70, None, 900)], "pid long")
    assert sorted(map(tuple, dense_codes(df, "pid").collect())) == [(5, 1), (70, 2), (900, 3)]
