"""Summaries from stored states equal those of all rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from resamplia.plans import increments, monitor, speedup

RESULTS = "run long, framework string, backend string, platform string, num_workers int, parallel boolean, elapsed double"
SAMPLES = "run long, framework string, backend string, platform string, pid long, time timestamp, pct_cpu double"


def timings(spark, low, high):
    rows = [
        (i % 17, "f" if i % 2 else "g", "b", "p" if i % 5 else None, 8 if i % 3 else None, None if i % 19 == 0 else i % 4 < 2, None if i % 23 == 0 else float(i % 13))
        for i in range(low, high)
    ]
    return spark.createDataFrame(rows, RESULTS)


def samples(spark, low, high):
    rows = [(i % 5, "f", "b" if i % 2 else None, "p", i % 7, dt.datetime(2024, 5, 1, i % 24), float(i * 37 % 400)) for i in range(low, high)]
    return spark.createDataFrame(rows, SAMPLES)


def same(a, b, digits=9):
    def rows(df):
        return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*b.columns).collect()), key=repr)

    assert rows(a) == rows(b)


def test_batches_add_up(spark, tmp_path):
    path = str(tmp_path / "states")
    for name, low, high in (("a", 0, 100), ("b", 100, 101), ("c/d %", 101, 400), ("b", 100, 101)):
        increments.add_states(increments.timing_states(timings(spark, low, high)), path, name)
    states, every = increments.read_timing_states(spark, path), timings(spark, 0, 400)
    same(increments.elapsed_trend(states), speedup.elapsed_trend(every))
    same(increments.elapsed_trend(states, ["backend", "framework"]), speedup.elapsed_trend(every, ["backend", "framework"]))
    same(increments.mean_speed_up(states), speedup.mean_speed_up(every))
    same(increments.worker_counts(states), speedup.worker_counts(every))
    assert increments.count_by(states).collect() == speedup.count_by(every).collect()
    assert states.count() < 400


def test_processes_add_up(spark, tmp_path):
    path = str(tmp_path / "states")
    for name, low, high in (("a", 0, 60), ("b", 60, 90)):
        increments.add_states(increments.monitor_states(samples(spark, low, high)), path, name)
    states, every = increments.read_monitor_states(spark, path), samples(spark, 0, 90)
    same(increments.cpu_range(states), monitor.cpu_range(every))
    same(increments.unusual_processes(states), monitor.unusual_processes(every))
    assert increments.count_by(states).collect() == speedup.count_by(every).collect()
    assert increments.first_run(states).count() == 2


def test_only_the_new_file_is_read(spark, tmp_path):
    """Old rows are unreadable when the second batch comes; the result has them nevertheless."""
    path, old, new = str(tmp_path / "states"), tmp_path / "old", tmp_path / "new"
    timings(spark, 0, 50).write.parquet(str(old))
    timings(spark, 50, 90).write.parquet(str(new))
    increments.add_states(increments.timing_states(spark.read.parquet(str(old))), path, "old")
    for part in old.glob("*.parquet"):
        part.write_bytes(b"not read")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "states" / "batch=old").iterdir()}
    increments.add_states(increments.timing_states(spark.read.parquet(str(new))), path, "new")
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "states" / "batch=old").iterdir()} == before
    states = increments.read_timing_states(spark, path)
    assert all("/batch=" in name for name in states.inputFiles())
    same(increments.elapsed_trend(states), speedup.elapsed_trend(timings(spark, 0, 90)))


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "states")
    increments.add_states(increments.timing_states(timings(spark, 0, 50)), path, "a")
    want = sorted(map(tuple, increments.read_timing_states(spark, path).collect()), key=repr)
    bad = timings(spark, 0, 60).withColumn("elapsed", F.when(F.col("run") == 3, F.raise_error(F.lit("gone")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="gone"):
        increments.add_states(increments.timing_states(bad), path, "a")
    assert sorted(map(tuple, increments.read_timing_states(spark, path).collect()), key=repr) == want
    with pytest.raises(ValueError):
        increments.add_states(increments.timing_states(timings(spark, 0, 5)), path, "")


def test_one_kind_only_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "states")
    one = timings(spark, 0, 40).where("not parallel")
    increments.add_states(increments.timing_states(one), path, "a")
    states = increments.read_timing_states(spark, path)
    same(increments.elapsed_trend(states), speedup.elapsed_trend(one))
    assert increments.mean_speed_up(states).count() == 0
    increments.add_states(increments.timing_states(one.limit(0)), path, "empty")
    assert increments.read_timing_states(spark, path).count() == states.count()
