from __future__ import annotations

from pyspark.sql import functions as F

from resamplia.operators import joins
from resamplia.operators.joins import counted_size, inner_join_nulls_match, is_small, kept, release, small_side
from resamplia.plans import bootstrap
from resamplia.plans.bootstrap import gathered_sets


def tables(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (None, 20), (3, 30)], "k int, y int")
    return left, right


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_keys_match_once(spark):
    left, right = tables(spark)
    joined = inner_join_nulls_match(left, right, ["k"])
    assert joined.columns == ["k", "x", "y"]
    assert sorted((r.x, r.y) for r in joined.collect()) == [("a", 10), ("b", 20)]


def test_counted_size_decides(spark, monkeypatch):
    left, right = tables(spark)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        small = inner_join_nulls_match(left, small_side(right), ["k"])
        monkeypatch.setattr(joins, "SMALL_ROWS", 2)
        large = inner_join_nulls_match(left, small_side(right), ["k"])
        assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)
        assert {(r.x, r.y) for r in small.collect()} == {(r.x, r.y) for r in large.collect()}
    finally:
        spark.conf.set(key, before)


def test_bytes_decide_too(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x" * 1000, [1, 2]), (2, None, None)], "k int, s string, a array<int>")
    n, used = counted_size(rows)
    assert n == 2 and 2 * 1000 <= used <= 2 * 1100
    assert counted_size(rows.limit(0)) == (0, 0)
    assert is_small(rows) and not is_small(rows, rows=1) and not is_small(rows, size=1999)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        monkeypatch.setattr(joins, "SMALL_BYTES", 1999)
        assert "SortMergeJoin" in plan(inner_join_nulls_match(rows.select("k"), small_side(rows), ["k"]))
    finally:
        spark.conf.set(key, before)


def test_kept_tables_can_be_given_up(spark):
    release()
    table = kept(spark.range(5).withColumn("x", F.col("id") + 1))
    small_side(table.groupBy("x").count())
    assert table.storageLevel.useMemory and spark.catalog is not None
    assert release() == 2 and not table.storageLevel.useMemory and release() == 0
    assert table.count() == 5


def test_gathered_sets_have_the_columns_asked_for(spark, monkeypatch):
    pairs = spark.range(50).select(F.col("id").alias("row_ix"), F.col("id").cast("double").alias("truth"), F.lit(1.0).alias("estimate"), F.repeat(F.lit("x"), 100).alias("text"))
    sets = gathered_sets(pairs, 3, 1)
    assert sets.columns == ["replicate", "row_ix", "truth", "estimate"] and sets.count() == 150
    assert "x" * 10 not in plan(sets) and "text" not in plan(sets)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        wide = gathered_sets(pairs, 3, 1, columns=["text"])
        assert wide.columns == ["replicate", "row_ix", "text"] and "BroadcastHashJoin" in plan(wide)
        monkeypatch.setattr(joins, "SMALL_BYTES", 2000)
        assert "BroadcastHashJoin" not in plan(gathered_sets(pairs, 3, 1, columns=["text"]))
    finally:
        spark.conf.set(key, before)


def test_gathered_sets_of_many_narrow_rows_are_broadcast_in_parts(spark, monkeypatch):
    pairs = spark.range(50).select(F.col("id").alias("row_ix"), F.col("id").cast("double").alias("truth"), F.lit(1.0).alias("estimate"))
    monkeypatch.setattr(bootstrap, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(joins, "SMALL_BYTES", 1000)
    sets = gathered_sets(pairs, 3, 1)
    assert plan(sets).count("BroadcastHashJoin") == 3 and sets.count() == 150
    monkeypatch.setattr(joins, "SMALL_BYTES", 700)
    sets = gathered_sets(pairs, 3, 1)
    assert plan(sets).count("BroadcastHashJoin") < 2 and sets.count() == 150
