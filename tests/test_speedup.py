from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from resamplia.operators.checks import duplicate_keys
from resamplia.plans import speedup

SCHEMA = (
    "run long, framework string, backend string, platform string, num_workers int, "
    "parallel boolean, elapsed double"
)


def results(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


BASE = [
    (1, "future", "mirai", "unix", 8, False, 30.0),
    (1, "future", "mirai", "unix", 8, True, 10.0),
    (2, "future", "mirai", "unix", 8, False, 40.0),
    (2, "future", "mirai", "unix", 8, True, 8.0),
    (3, "foreach", "mirai", "unix", 8, False, 16.0),
    (3, "foreach", "mirai", "unix", 8, True, 4.0),
]


def test_speed_up(spark):
    rows = speedup.speed_ups(results(spark, BASE)).collect()
    assert sorted((r.run, r.speed_up) for r in rows) == [(1, 3.0), (2, 5.0), (3, 4.0)]
    assert {r.run: r.log2_speed_up for r in rows}[3] == 2.0


def test_null_keys_match(spark):
    rows = [(1, "future", "mirai", None, 8, p, e) for p, e in ((False, 6.0), (True, 3.0))]
    df = results(spark, rows)
    assert [r.speed_up for r in speedup.speed_ups(df).collect()] == [2.0]
    assert speedup.mean_speed_up(df, by=["platform"]).first().mean == 2.0


def test_missing_side_is_dropped(spark):
    df = results(spark, BASE + [(9, "future", "psock", "unix", 8, True, 1.0), (8, "x", "y", "z", 8, False, 1.0)])
    assert speedup.speed_ups(df).count() == 3
    assert speedup.mean_speed_up(df).count() == 2


def test_platforms_are_kept_apart(spark):
    mac = [(1, "future", "mirai", "macOS", 12, p, e) for p, e in ((False, 60.0), (True, 2.0))]
    df = results(spark, BASE + mac)
    assert speedup.speed_ups(df).count() == 4
    assert speedup.speed_ups(df, speedup.RUN_KEYS_ONE_PLATFORM).count() == 6
    rows = speedup.speed_ups_with_workers(df).collect()
    assert {(r.platform, r.ideal) for r in rows} == {("unix", 8), ("macOS", 12)} and len(rows) == 4


def test_worker_counts_do_not_multiply_rows(spark):
    """Two scenarios with the same worker count on a platform give one reference line."""
    assert speedup.speed_ups_with_workers(results(spark, BASE)).count() == 3


def test_zero_and_null_times(spark):
    rows = [
        (1, "f", "b", "p", 8, False, 6.0),
        (1, "f", "b", "p", 8, False, None),
        (1, "f", "b", "p", 8, True, 0.0),
        (1, "f", "b", "p", 8, True, None),
        (1, "f", "b", "p", 8, True, 2.0),
    ]
    df = results(spark, rows)
    ups = Counter(r.speed_up for r in speedup.speed_ups(df).collect())
    assert ups == {3.0: 1, None: 5}
    assert speedup.mean_speed_up(df).first().mean == 3.0


@pytest.mark.parametrize("keys", [speedup.RUN_KEYS, speedup.RUN_KEYS_ONE_PLATFORM])
def test_mean_equals_mean_of_joined_pairs(spark, keys):
    # One run holds a third of the rows, on both sides of the join.
    rows = [
        (0 if i % 3 == 0 else i % 11, "f" if i % 2 else "g", "b", "p" if i % 5 else None, 8, i % 4 < 2, 1.0 + i % 13)
        for i in range(600)
    ]
    df = results(spark, rows)
    joined = speedup.speed_ups(df, keys).groupBy("backend", "framework").agg(F.avg("speed_up").alias("mean"))
    expected = {r.framework: r.mean for r in joined.collect()}
    found = {r.framework: r.mean for r in speedup.mean_speed_up(df, keys=keys).collect()}
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, rel=1e-12)


def test_best_keeps_ties_and_rounds_half_to_even(spark):
    means = spark.createDataFrame([("a", 2.25), ("b", 2.25), ("c", 1.0), ("d", None)], "backend string, mean double")
    assert {r.backend for r in speedup.best_configurations(means).collect()} == {"a", "b"}
    rows = [(1, "f", "b", "p", 8, False, 9.0), (1, "f", "b", "p", 8, True, 4.0)]
    assert speedup.best_speed_up(results(spark, rows)).first().best_speed_up == 2.2


def test_trend(spark):
    found = {r.framework: r for r in speedup.elapsed_trend(results(spark, BASE)).collect()}
    assert found["future"].slope == pytest.approx(9.0 - 35.0)
    assert found["future"].intercept == pytest.approx(35.0 + 26.0)


def test_trend_without_parallel_rows(spark):
    found = speedup.elapsed_trend(results(spark, BASE[:1])).first()
    assert found.slope is None and found.intercept is None and found.n == 1


def test_counts_are_sorted(spark):
    rows = speedup.count_by(results(spark, BASE)).collect()
    assert [(r.framework, r.n) for r in rows] == [("foreach", 2), ("future", 4)]
    assert speedup.worker_counts(results(spark, BASE)).count() == 2


def test_first_worker_count(spark):
    df = results(spark, BASE[2:] + [(0, "a", "b", "c", 3, True, 1.0)])
    assert speedup.first_worker_count(df, ["run"]).first().num_workers == 3
    tie = results(spark, [(0, "a", "b", "c", n, True, 1.0) for n in (9, 3, 5)])
    assert speedup.first_worker_count(tie, ["run"]).first().num_workers == 3


def test_duplicate_runs(spark):
    df = speedup.baseline(results(spark, BASE + BASE[:1]))
    rows = duplicate_keys(df, speedup.RUN_KEYS).collect()
    assert [(r.run, r.n) for r in rows] == [(1, 2)]


def hot_runs(spark):
    """Run 0 holds a third of the parallel rows, most of them copies of one row; run 1 has many sequential rows."""
    ids = spark.range(0, 30_000, 1, 8)
    run = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1)
    elapsed = F.when(F.col("id") % 6 == 0, 4.0).otherwise(F.col("id") % 1000 + 1.0)
    parallel = ids.select(run.cast("bigint").alias("run"), F.lit(True).alias("parallel"), elapsed.alias("elapsed"))
    base = spark.range(500).select(F.col("id").alias("run"), F.lit(False).alias("parallel"), F.lit(2.0).alias("elapsed"))
    many = spark.range(0, 700).select(F.lit(1).cast("bigint").alias("run"), F.lit(False).alias("parallel"), (F.col("id") % 7 + 0.5).alias("elapsed"))
    return parallel.unionByName(base).unionByName(many)


def as_join(df):
    """What the speed-ups are, by a join of the table with itself."""
    base = df.where("not parallel").select(F.col("run").alias("_run"), F.col("elapsed").alias("baseline"))
    return df.where("parallel").join(base, F.col("run") == F.col("_run")).select("run", "elapsed", "baseline")


def test_large_runs_are_dealt_to_a_grid(spark, monkeypatch):
    df = hot_runs(spark)
    want = Counter(map(tuple, as_join(df).collect()))
    for limit in (100_000, 300, 40):
        monkeypatch.setattr(speedup, "CELL_ROWS", limit)
        rows = speedup.speed_ups(df, ["run"]).collect()
        assert Counter((r.run, r.elapsed, r.baseline) for r in rows) == want
        assert all(r.speed_up == r.baseline / r.elapsed for r in rows)


def test_no_cell_is_much_larger_than_its_limit(spark, monkeypatch):
    df = hot_runs(spark)
    sizes = df.groupBy("run").agg(F.ceil(F.count_if("parallel") / 400).cast("int").alias("_rows"), F.ceil(F.count_if(~F.col("parallel")) / 400).cast("int").alias("_columns"))
    cells = speedup._dealt(df, sizes.where("run < 2"), ["run"]).groupBy("run", "_row", "_column")
    found = cells.agg(F.sum(F.when(F.col("parallel"), F.col("_copies"))).alias("p"), F.sum(F.when(~F.col("parallel"), F.col("_copies"))).alias("s"), F.count("*").alias("moved")).collect()
    assert len(found) == 25 + 2
    assert max(r.p for r in found) <= 1.5 * 400 and max(r.s or 0 for r in found) <= 1.5 * 400 and max(r.moved for r in found) <= 1.5 * 400
    hot = [r.p for r in found if r.run == 0]
    assert sum(hot) == 10_000 and max(hot) < 1.5 * sum(hot) / len(hot)


def test_timing_rows_are_shuffled_once(spark, tmp_path):
    results(spark, BASE).write.parquet(f"{tmp_path}/timings")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (speedup.RUN_KEYS, speedup.RUN_KEYS_ONE_PLATFORM):
            plan = speedup.speed_ups(spark.read.parquet(f"{tmp_path}/timings"), keys)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
