from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from resamplia.functions import scalars
from resamplia.plans.speedup import first_worker_count
from resamplia.sources import files
from resamplia.sources.pairs import observed_predicted

TIMING = {"user_self": 1.5, "sys_self": 0.25, "elapsed": 34.36, "user_child": 0.0, "sys_child": 0.0}


def tags(run, backend="mirai", platform="source", parallel=False):
    return dict(
        parallel=parallel, run=run, num_workers=8, framework="future", backend=backend, platform=platform
    )


def test_timing_row(spark):
    row = files.timing_row(spark, TIMING, **tags(482)).first()
    assert row.elapsed == 34.36 and row.run == 482 and row.parallel is False
    assert row.num_workers == 8 and row.platform == "source"


def test_results_round_trip(spark, tmp_path):
    root = str(tmp_path)
    for run, backend in ((1, "mirai"), (2, "foreach")):
        seq = files.timing_row(spark, TIMING, **tags(run, backend))
        par = files.timing_row(spark, {"elapsed": 9.5}, **tags(run, backend, parallel=True))
        suffix = files.run_suffix("foreach/doFuture/%dopar%", backend, run)
        files.save_results(files.bind_rows(seq, par), root, suffix)
    files.save_monitor(files.timing_row(spark, {"pct_cpu": 1.0}), 7, root, "future-mirai-1")
    rows = files.read_results(spark, root).collect()
    assert len(rows) == 4
    assert {r.backend for r in rows} == {"mirai", "multisession"} and {r.platform for r in rows} == {"unix"}
    assert [r.user_self for r in rows if r.parallel] == [None, None]
    merged = files.read_results(spark, root, schema=None)
    assert merged.count() == 4 and set(merged.columns) == set(TIMING) | set(tags(1))


def test_monitor_round_trip(spark, tmp_path):
    root = str(tmp_path)
    time = dt.datetime(2024, 5, 1)
    rows = [(time, 11, 3.0), (time, 12, None)]
    df = files.with_tags(spark.createDataFrame(rows, "time timestamp, pid long, pct_cpu double"), **tags(5))
    files.save_monitor(df, 99, root, "future-mirai-5")
    found = files.read_monitor(spark, root).collect()
    assert [(r.pid, r.main_pid, r.rel_time, r.platform) for r in found] == [(11, 99, None, "unix")]
    assert files.read_results(spark, root).count() == 0


def test_first_worker_count_by_file_name(spark, tmp_path):
    root = str(tmp_path)
    for name, workers in (("b", 12), ("a", 8), ("c", 4)):
        row = files.timing_row(spark, {"pct_cpu": 1.0}, **{**tags(1), "num_workers": workers})
        files.save_monitor(row, 1, root, name)
    samples = files.read_monitor(spark, root)
    assert first_worker_count(samples, ["_metadata.file_path"]).first().num_workers == 8


def test_missing_folder_gives_no_rows(spark, tmp_path):
    assert files.read_monitor(spark, str(tmp_path)).count() == 0
    assert files.read_results(spark, str(tmp_path)).schema["elapsed"].dataType.simpleString() == "double"


def test_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = files.bind_rows(
        *[
            files.timing_row(spark, TIMING, **{**tags(run), "framework": framework})
            for run in (1, 2)
            for framework in ("future", "foreach/doFuture/%dopar%")
        ]
    )
    files.write_table(rows, path)
    back = spark.read.parquet(path)
    assert {(r.framework, r.run) for r in back.collect()} == {
        (f, run) for run in (1, 2) for f in ("future", "foreach/doFuture/%dopar%")
    }
    plan = back.where("framework = 'future' AND run = 1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*framework", plan) and "EqualTo(run,1)" in plan


def test_main_pid_from_its_own_table(spark):
    keys = "run long, framework string, backend string, platform string"
    rows = spark.createDataFrame([(1, "f", "b", None, 10), (2, "f", "b", "p", 11)], f"{keys}, pid long")
    pids = spark.createDataFrame(
        [(1, "f", "b", None, 70), (2, "f", "b", "p", 80)], f"{keys}, main_pid long"
    )
    found = files.attach_main_pid(rows, pids)
    assert sorted((r.pid, r.main_pid) for r in found.collect()) == [(10, 70), (11, 80)]
    assert found.columns == [*rows.columns, "main_pid"]
    missing = files.attach_main_pid(rows, pids.limit(1).unionByName(pids.limit(1)))
    assert sorted((r.pid, r.main_pid) for r in missing.collect()) == [(10, 70), (11, None)]
    two = pids.unionByName(pids.withColumn("main_pid", F.lit(1).cast("long")))
    with pytest.raises(Exception, match="several main_pids"):
        files.attach_main_pid(rows, two).collect()


def test_stacking_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert sorted(map(tuple, files.bind_rows(a, b).collect()), key=str) == [(1, "x", None), (None, "y", 2.0)]


def test_recodes(spark):
    df = spark.createDataFrame(
        [("foreach", "source"), ("mirai", "mac.binary.big-sur-arm64"), (None, None), ("psock", "win.binary")],
        "backend string, platform string",
    )
    found = df.select(scalars.recode_backend(), scalars.recode_platform()).collect()
    assert [tuple(r) for r in found] == [
        ("multisession", "unix"),
        ("mirai", "macOS"),
        (None, None),
        ("psock", "win.binary"),
    ]


def test_text_and_time(spark):
    early, late = dt.datetime(2024, 5, 1, 0, 3, 7), dt.datetime(2024, 5, 1, 0, 3, 9, 500000)
    df = spark.createDataFrame([(early, late)], "a timestamp, b timestamp")
    row = df.select(
        scalars.seconds_between(F.col("b"), F.col("a")).alias("s"),
        scalars.minutes_seconds(F.col("a")).alias("m"),
        (scalars.epoch_seconds(F.col("b")) % 60).alias("e"),
        scalars.time_axis_label(F.lit(2.5)).alias("x"),
        scalars.file_path("results", F.lit("res-1")).alias("p"),
        scalars.without(F.lit("ab/c ab/d"), "ab/").alias("w"),
    ).first()
    assert (row.s, row.m, row.e) == (2.5, "03:07", 9.5)
    assert row.x == "Time (min:sec)\ntotal time: 3s" and row.p == "results/res-1" and row.w == "c d"


def test_pairs_from_any_table(spark):
    df = spark.createDataFrame([(0, 3, "m")], "id int, n int, model string")
    found = observed_predicted(df, "n", F.col("n") + 1, "id", ["model"])
    assert [tuple(r) for r in found.collect()] == [(0, "m", 3.0, 4.0)]
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "string", "double", "double"]


@pytest.mark.parametrize("word", ["localCheckpoint", "toPandas", "crossJoin"])
def test_never_used(word):
    root = Path(__file__).resolve().parent.parent / "resamplia"
    assert not [p for p in root.rglob("*.py") if word in p.read_text()]


def test_large_run_is_written_by_several_tasks(spark, tmp_path):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 200_000, 1, 8).select(
            F.lit("f").alias("framework"), F.lit("b").alias("backend"), F.lit(1).alias("run"), "id"
        )
        path = tmp_path / "results"
        files.write_table(df, str(path))
        assert len(list(path.rglob("*.parquet"))) > 3
        assert spark.read.parquet(str(path)).count() == 200_000
    finally:
        for key in settings:
            spark.conf.unset(key)


def runs_table(spark, rows):
    return spark.createDataFrame(rows, "elapsed double, parallel boolean, framework string, backend string, platform string, run long")


RUN_SCHEMA = "elapsed double, parallel boolean, framework string, backend string, platform string, run long"
UNIQUE = [*files.RUN_FOLDERS, "parallel"]


def read_back(spark, path):
    schema = spark.createDataFrame([], RUN_SCHEMA).schema
    return sorted(map(tuple, files.read_runs(spark, path, schema).select(*schema.fieldNames()).collect()), key=repr)


def some_runs():
    odd = "foreach/doFuture/%dopar%"
    return [(float(10 * r + p), bool(p), f, "mirai", s, r) for r in (1, 2, 30) for p in (0, 1) for f in ("future", odd) for s in ("unix", None)]


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path, rows = str(tmp_path / "runs"), some_runs()
    files.replace_runs(runs_table(spark, rows), path, UNIQUE)
    assert read_back(spark, path) == sorted(rows, key=repr)
    files.replace_runs(runs_table(spark, rows), path, UNIQUE)
    assert read_back(spark, path) == sorted(rows, key=repr)
    again = [(e + 0.5, p, f, b, s, r) for e, p, f, b, s, r in rows if r == 2 and s is None]
    new = [(1.0, True, "future", "mirai", "unix", 4)]
    for _ in range(2):
        files.replace_runs(runs_table(spark, again[1:] + new), path, UNIQUE)
    kept = [r for r in rows if not (r[5] == 2 and r[4] is None)]
    # What a rewritten run no longer has is gone: here its first row.
    assert read_back(spark, path) == sorted(kept + again[1:] + new, key=repr)
    files.replace_runs(runs_table(spark, []), path)
    assert read_back(spark, path) == sorted(kept + again[1:] + new, key=repr)


def test_after_a_failing_task_the_table_is_as_it_was(spark, tmp_path):
    path, rows = str(tmp_path / "runs"), some_runs()
    files.replace_runs(runs_table(spark, rows), path)
    crash = F.when(F.col("run") == 30, F.raise_error(F.lit("sampler died")).cast("double")).otherwise(-1.0)
    with pytest.raises(Exception, match="sampler died"):
        files.replace_runs(runs_table(spark, rows).repartition(8).withColumn("elapsed", crash), path)
    assert read_back(spark, path) == sorted(rows, key=repr)
    with pytest.raises(Exception, match="repeated key"):
        files.replace_runs(runs_table(spark, rows + [(99.0, False, "future", "mirai", None, 2)]), path, UNIQUE)
    assert read_back(spark, path) == sorted(rows, key=repr)


def test_one_run_is_read_from_its_folder(spark, tmp_path):
    path = str(tmp_path / "runs")
    files.replace_runs(runs_table(spark, some_runs()), path)
    schema = spark.createDataFrame([], RUN_SCHEMA).schema
    for folder in (tmp_path / "runs").rglob("run=1"):
        for part in folder.glob("*.parquet"):
            part.write_bytes(b"not read")
    assert files.read_runs(spark, path, schema).where("run = 2").count() == 8


def test_a_large_run_is_replaced_by_several_tasks(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 200_000, 1, 8).select("id", *[F.lit("x").alias(c) for c in files.SCENARIO], F.lit(1).alias("run"))
        for _ in range(2):
            files.replace_runs(rows, str(tmp_path / "runs"), ["id"])
        assert len(list((tmp_path / "runs").rglob("*.parquet"))) > 3
        assert spark.read.parquet(str(tmp_path / "runs")).count() == 200_000
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_files_by_name_each_once(spark, tmp_path):
    root = str(tmp_path / "some results")
    for name, n in (("res-a b+c%20-1.parquet", 2), ("res-monitor-2", 3), ("monitor-3", 4), ("other", 5)):
        spark.range(n).repartition(2).write.parquet(f"{root}/{name}")
    found = files.stack_named(spark, root, ["res-", "monitor-", "-2"], ["id"]).groupBy("file").count().collect()
    assert {(r["file"], r["count"]) for r in found} == {("res-a b+c%20-1.parquet", 2), ("res-monitor-2", 3), ("monitor-3", 4)}
    schema = spark.range(1).schema
    assert files.named(spark, root, ["nothing"], schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.named(spark, root, ["nothing"])


def test_a_filter_on_the_file_prunes_files(spark, tmp_path):
    root = str(tmp_path)
    for name in ("res-1", "res-2"):
        spark.range(3).coalesce(1).write.parquet(f"{root}/{name}")
    for part in (tmp_path / "res-1").glob("*.parquet"):
        part.write_bytes(b"not read")
    rows = files.named(spark, root, ["res-"], spark.range(1).schema)
    assert rows.where("file = 'res-2'").count() == 3
    with pytest.raises(Exception, match="res-1"):
        rows.count()


def test_main_pid_from_the_file_beside(spark, tmp_path):
    root = str(tmp_path)
    for run in (1, 2, 3):
        row = files.timing_row(spark, {"pct_cpu": 1.0}, **tags(run))
        files.save_monitor(row.withColumn("pid", F.lit(5).cast("long")), 7, root, f"future-mirai-{run}")
        if run < 3:
            files.save_sidecar(spark, 70 + run, root, f"future-mirai-{run}")
    found = {(r.file, r.run): r.main_pid for r in files.read_monitor_files(spark, root).collect()}
    assert found == {("monitor-future-mirai-1", 1): 71, ("monitor-future-mirai-2", 2): 72, ("monitor-future-mirai-3", 3): None}
    # Written again, a sidecar replaces itself.
    files.save_sidecar(spark, 99, root, "future-mirai-1")
    assert {r.run: r.main_pid for r in files.read_monitor_files(spark, root).collect()} == {1: 99, 2: 72, 3: None}
    spark.createDataFrame([(1,), (2,)], "main_pid long").write.parquet(f"{root}/pid-future-mirai-3")
    with pytest.raises(Exception, match="several values in the sidecars of future-mirai-3"):
        files.read_monitor_files(spark, root).collect()


def test_monitors_without_any_sidecar(spark, tmp_path):
    assert files.read_monitor_files(spark, str(tmp_path)).count() == 0
    files.save_monitor(files.timing_row(spark, {"pct_cpu": 1.0}, **tags(1)), 7, str(tmp_path), "x")
    assert [r.main_pid for r in files.read_monitor_files(spark, str(tmp_path)).collect()] == [None]
