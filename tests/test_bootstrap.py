from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from resamplia.functions.metrics import METRICS, complete_pairs, metric_aggregates, to_long
from resamplia.operators.checks import replicate_sizes
from resamplia.plans import bootstrap
from resamplia.plans.bootstrap import (
    analysis_sets,
    bootstrap_auc,
    bootstrap_metrics,
    gathered_sets,
    percentile_ci,
    poisson_metrics,
    reduce_sets,
)


@pytest.fixture(scope="module")
def normal(spark):
    """2000 rows of standard normal truth with 0.1 noise."""
    df = spark.range(0, 2000, 1, 3).select(
        F.col("id").alias("row_ix"), F.randn(1).alias("truth"), F.randn(2).alias("noise")
    )
    df = df.withColumn("estimate", F.col("truth") + 0.1 * F.col("noise")).drop("noise").cache()
    df.count()
    return df


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_exactly_b_replicates_of_n_rows(spark, normal):
    for sets in (gathered_sets, analysis_sets):
        sizes = replicate_sizes(sets(normal, 40, 1)).collect()
        assert {(r.replicate, r.n) for r in sizes} == {(b, 2000) for b in range(1, 41)}


def test_whole_data_is_in_the_expected_range(normal):
    found = normal.agg(*metric_aggregates()).first()
    assert found.rmse == pytest.approx(0.1, abs=0.006)
    assert found.rsq == pytest.approx(0.99, abs=0.003)
    assert found.mae == pytest.approx(0.08, abs=0.005)
    assert found.ccc == pytest.approx(0.995, abs=0.002)


@pytest.mark.parametrize("method", ["gather", "scan", "poisson"])
def test_spread_of_rmse(normal, method):
    """The standard deviation of rmse is close to sigma / sqrt(2 n)."""
    if method == "poisson":
        scores = poisson_metrics(normal, 300, 8)
    else:
        scores = bootstrap_metrics(normal, 300, 8)
    if method == "gather":
        scores = gathered_sets(normal, 300, 8).groupBy("replicate").agg(*metric_aggregates())
    n, mean, spread = scores.agg(F.count("*"), F.avg("rmse"), F.stddev("rmse")).first()
    assert n == 300
    assert mean == pytest.approx(0.1, abs=0.006)
    assert spread == pytest.approx(0.1 / math.sqrt(4000), rel=0.2)
    bad = scores.where("mae > rmse OR ccc > sqrt(rsq) + 1e-12 OR rsq > 1")
    assert bad.count() == 0


def test_repeatable_and_free_of_partitions(normal):
    one = bootstrap_metrics(normal.repartition(1), 5, 2).select("replicate", F.round("rmse", 9))
    many = bootstrap_metrics(normal.repartition(9), 5, 2).select("replicate", F.round("rmse", 9))
    assert rows_of(one) == rows_of(many)
    other = bootstrap_metrics(normal, 5, 3).select("replicate", F.round("rmse", 9))
    assert rows_of(one) != rows_of(other)


def test_single_replicate(normal):
    last = bootstrap_metrics(normal, 12, 2, first=12)
    every = bootstrap_metrics(normal, 12, 2).where("replicate = 12")
    digits = [F.round(m, 9) for m in METRICS]
    assert rows_of(last.select("replicate", *digits)) == rows_of(every.select("replicate", *digits))


@pytest.mark.parametrize("size", [40, 2000])
def test_sums_equal_drawn_rows(normal, size):
    """One stream of draws: sums of weights and added draws give what the drawn rows give."""
    pairs = normal.where(F.col("row_ix") < size).withColumn("estimate", F.when(F.col("row_ix") % 3 > 0, F.col("estimate")))
    found = {r.replicate: r for r in bootstrap_metrics(pairs, 7, 5).collect()}
    expected = analysis_sets(pairs, 7, 5).groupBy("replicate").agg(*metric_aggregates(), F.count("*").alias("n")).collect()
    assert len(found) == len(expected) == 7
    for row in expected:
        assert found[row.replicate].n == row.n
        for metric in METRICS:
            assert found[row.replicate][metric] == pytest.approx(row[metric], rel=1e-9)


def test_every_replicate_of_every_model_is_there(spark):
    rows = [(i, m, float(i), float(i) if m == "all" or i == 3 else None) for i in range(200) for m in ("all", "one", None)]
    pairs = spark.createDataFrame(rows, "row_ix long, model string, truth double, estimate double")
    for scores in (bootstrap_metrics(pairs, 60, 1, by=["model"]), poisson_metrics(pairs, 60, 1, by=["model"])):
        found = scores.collect()
        assert Counter((r.model) for r in found) == {"all": 60, "one": 60, None: 60}
        without = [r for r in found if r.model == "one" and r.n == 0]
        assert 5 < len(without) < 55 and all(r.rmse is None for r in without)
        assert all(r.rmse == 0 for r in found if r.n > 0)


def test_weights_are_computed_once_and_rows_stay(normal):
    plan = bootstrap_metrics(normal, 300, 1)._jdf.queryExecution().executedPlan().toString()
    # Replicates are a constant array, exploded once for the frame of results and once for the weights.
    assert plan.count("Generate explode(org.apache.spark.sql.catalyst.expressions.UnsafeArrayData") == 2
    large = normal.sparkSession.range(0, 2_000_000, 1, 4).select(F.col("id").alias("row_ix"), F.col("id").cast("double").alias("truth"), F.lit(1.0).alias("estimate"))
    plan = poisson_metrics(large, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.rindex("Generate explode") :]


def test_models_share_draws(spark, normal):
    same = normal.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    gathered = gathered_sets(same, 4, 6, by=["model"]).groupBy("replicate", "model").agg(*metric_aggregates())
    for scores in (bootstrap_metrics(same, 4, 6, by=["model"]), gathered):
        a = scores.where("model = 'a'").select("replicate", F.round("rmse", 9), F.round("ccc", 9))
        b = scores.where("model = 'b'").select("replicate", F.round("rmse", 9), F.round("ccc", 9))
        assert rows_of(a) == rows_of(b) and a.count() == 4


def test_null_pairs_are_drawn_but_not_scored(spark):
    rows = [(i, float(i), None if i % 2 else float(i)) for i in range(100)]
    pairs = spark.createDataFrame(rows, "row_ix long, truth double, estimate double")
    sizes = [r.n for r in replicate_sizes(analysis_sets(pairs, 50, 1)).collect()]
    assert 40 < sum(sizes) / len(sizes) < 60
    assert bootstrap_metrics(pairs, 10, 1).agg(F.max("rmse")).first()[0] == 0.0


def test_poisson_null_model_and_constant(spark):
    rows = [(i, m, float(i % 7), 0.1) for i in range(90) for m in ("x", None)]
    pairs = spark.createDataFrame(rows, "row_ix long, model string, truth double, estimate double")
    scores = poisson_metrics(pairs, 20, 1, by=["model"]).collect()
    assert len(scores) == 40
    assert {s.rsq for s in scores} == {None} and {s.ccc for s in scores} == {0.0}


def test_poisson_equals_explicit_copies(spark, normal):
    """Weighted sums give the same as repeating each row."""
    from resamplia.operators.resample import with_poisson_weight

    copies = with_poisson_weight(complete_pairs(normal), 1.0, 1, 6, 4).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("w")))
    )
    expected = copies.groupBy("replicate").agg(*metric_aggregates()).orderBy("replicate").collect()
    found = poisson_metrics(normal, 6, 4).orderBy("replicate").collect()
    for a, b in zip(found, expected):
        assert a.replicate == b.replicate
        for metric in METRICS:
            assert a[metric] == pytest.approx(b[metric], rel=1e-9)


def test_sparse_or_empty_index_is_refused(spark):
    schema = "row_ix long, truth double, estimate double"
    for index in ([], [1], [0, 5], [-1, 0], [0, 0, 2], [0, 0, 3, 3], [0, 1, 1, 3], [None], [0, None, 1]):
        pairs = spark.createDataFrame([(i, 1.0, 1.0) for i in index], schema)
        with pytest.raises(ValueError):
            analysis_sets(pairs, 3, 1)
    by_model = schema + ", model string"
    for rows in ([(-1, "a")], [(0, "a"), (10, "a"), (20, "a")], [(0, "a"), (0, "a"), (1, "a")], [(0, "a"), (1, "a"), (0, "b")], [(0, "a"), (1, "b")]):
        pairs = spark.createDataFrame([(i, 1.0, 1.0, m) for i, m in rows], by_model)
        with pytest.raises(ValueError):
            bootstrap_metrics(pairs, 3, 1, by=["model"])
    for index in ([None, 1], [4, 4], [None]):
        with pytest.raises(ValueError):
            poisson_metrics(spark.createDataFrame([(i, 1.0, 1.0) for i in index], schema), 3, 1)
    assert poisson_metrics(spark.createDataFrame([(i, 1.0, 1.0) for i in (5, 900)], schema), 3, 1).count() == 3


def test_the_broadcast_limit_changes_no_value(normal, monkeypatch):
    pairs = normal.withColumn("model", F.lit("m"))
    digits = [F.round(m, 9) for m in METRICS]
    results = []
    for limit in (1_000_000, 1):
        monkeypatch.setattr(bootstrap, "BROADCAST_ROWS", limit)
        results.append([
            rows_of(bootstrap_metrics(pairs, 3, 1, by=["model"]).select("replicate", "n", *digits)), rows_of(poisson_metrics(pairs, 3, 1).select("replicate", "n", *digits)),
            rows_of(gathered_sets(pairs, 3, 1)), rows_of(analysis_sets(pairs, 3, 1)),
        ])
    assert results[0] == results[1]


@pytest.mark.parametrize("size", [100, 300])
def test_bootstrap_auc(spark, size):
    rows = [(i, float(i * 7 % 5 % 2), float(i * 31 % 57)) for i in range(size)]
    pairs = spark.createDataFrame(rows, "row_ix long, truth double, estimate double")
    found = {r.replicate: r for r in bootstrap_auc(pairs, 4, 3).collect()}
    drawn = analysis_sets(pairs, 4, 3).collect()
    for replicate in range(1, 5):
        ones = [r.estimate for r in drawn if r.replicate == replicate and r.truth == 1]
        zeros = [r.estimate for r in drawn if r.replicate == replicate and r.truth == 0]
        wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
        assert found[replicate].roc_auc == pytest.approx(wins / len(ones) / len(zeros), abs=1e-12)
        assert found[replicate].positives + found[replicate].negatives == size


def test_auc_moves_rows_once(spark):
    """Between the weights and the sums per range no row is exchanged."""
    rows = [(i, float(i % 2), float(i * 31 % 997)) for i in range(5000)]
    pairs = spark.createDataFrame(rows, "row_ix long, truth double, estimate double")
    plan = bootstrap_auc(pairs, 50, 3)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate explode(concat(")]
    assert after.count("Exchange") <= 2  # one row per replicate and range


def test_percentile_interval(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", None)]
    scores = spark.createDataFrame(rows, "metric string, estimate double")
    found = {r.metric: r for r in percentile_ci(scores, level=0.9).collect()}
    assert (found["a"].lower, found["a"].mean, found["a"].upper) == (5.0, 50.0, 95.0)
    assert found["b"].lower is None and (found["a"].replicates, found["b"].replicates) == (101, 0)


def test_interval_covers_the_estimate(normal):
    bounds = percentile_ci(to_long(bootstrap_metrics(normal, 200, 5), ["replicate"]))
    whole = normal.agg(*metric_aggregates()).first()
    for row in bounds.collect():
        assert row.lower < whole[row.metric] < row.upper


@pytest.mark.parametrize("method", [gathered_sets, analysis_sets])
def test_user_function_by_pieces(normal, method):
    sets = method(normal, 8, 9)

    def squared(part: pd.DataFrame) -> dict[str, float]:
        error = part["truth"] - part["estimate"]
        return {"n": len(part), "squared": (error * error).sum()}

    sums = reduce_sets(sets, squared, ["n", "squared"])
    found = {r.replicate: math.sqrt(r.squared / r.n) for r in sums.collect()}
    expected = {r.replicate: r.rmse for r in sets.groupBy("replicate").agg(*metric_aggregates()).collect()}
    assert found.keys() == expected.keys()
    for replicate, value in expected.items():
        assert found[replicate] == pytest.approx(value, rel=1e-9)


def test_other_native_metrics(normal):
    bias = F.avg(F.col("estimate") - F.col("truth")).alias("bias")
    found = analysis_sets(normal, 5, 1).groupBy("replicate").agg(bias)
    assert found.columns == ["replicate", "bias"] and found.count() == 5


def test_gather_plan_has_one_shuffle(normal):
    sets = gathered_sets(normal, 1000, 1).groupBy("replicate").agg(*metric_aggregates())
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def hot_scores(spark, n=3000):
    """A third of all rows has one score, another tenth the largest there is."""
    score = F.when(F.col("id") % 3 == 0, 50.0).when(F.col("id") % 10 == 1, math.inf).when(F.col("id") % 50 == 2, -math.inf).otherwise((F.col("id") * 37 % 101).cast("double"))
    return spark.range(0, n, 1, 5).select(F.col("id").alias("row_ix"), (F.col("id") * 7 % 5 < 2).cast("double").alias("truth"), score.alias("estimate"))


def test_auc_with_hot_scores(spark):
    pairs = hot_scores(spark)
    found = {r.replicate: r for r in bootstrap_auc(pairs, 3, 3).collect()}
    for replicate, rows in pd.DataFrame(analysis_sets(pairs, 3, 3).collect(), columns=["replicate", *pairs.columns]).groupby("replicate"):
        ones, zeros = (Counter(rows[rows.truth == k].estimate) for k in (1, 0))
        wins = sum(a * b * (1 if x > y else 0.5 if x == y else 0) for x, a in ones.items() for y, b in zeros.items())
        assert (found[replicate].positives, found[replicate].negatives) == (ones.total(), zeros.total())
        assert found[replicate].roc_auc == pytest.approx(wins / ones.total() / zeros.total(), abs=1e-12)


def test_hot_scores_fill_no_task(spark):
    """A third of all rows on one score: dealt out, no task gets above twice the mean."""
    n, tasks = 30_000, 16
    placed, hot = bootstrap._auc_parts(hot_scores(spark, n), n, tasks)
    assert hot == [50.0, math.inf]
    own = placed.where(F.col("estimate").isin(hot))
    assert own.select("_range").distinct().count() == 2
    assert placed.where(~F.col("estimate").isin(hot)).join(own.select("_range").distinct(), "_range").count() == 0
    settings = {"spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        dealt = own.repartition(tasks, "_range", "_part").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = [r["count"] for r in dealt] + [0] * (tasks - len(dealt))
        assert max(sizes) <= 2 * sum(sizes) / tasks
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # Numbers of ranges never fall when the score grows.
    order = placed.groupBy("estimate").agg(F.min("_range").alias("a"), F.max("_range").alias("b")).orderBy("estimate").collect()
    assert all(r.a == r.b for r in order) and all(x.b <= y.a for x, y in zip(order, order[1:]))


def test_more_cuts_keep_the_inner_ones(spark):
    from resamplia.operators.ordered import Ranges

    keys = spark.range(0, 100).select(F.col("id").cast("double").alias("k"))
    ranges = Ranges((20.0, 50.0), ((5.0, 10.0), (30.0,), ())).with_cuts([7.0, 50.0, 70.0])
    rows = keys.select("k", ranges.number("k").alias("n")).orderBy("k").collect()
    edges = [a.k for a, b in zip(rows, rows[1:]) if b.n != a.n]
    assert edges == [5.0, 7.0, 10.0, 20.0, 30.0, 50.0, 70.0] and all(a.n <= b.n for a, b in zip(rows, rows[1:]))


def test_infinite_values_count_where_they_are_drawn(spark):
    rows = [(i, 1.0 * i, math.inf if i == 7 else i + 1.0) for i in range(400)]
    pairs = spark.createDataFrame(rows, "row_ix long, truth double, estimate double")
    drawn = analysis_sets(pairs, 40, 2).groupBy("replicate").agg(F.max("estimate").alias("top")).collect()
    found = {r.replicate: r.rmse for r in bootstrap_metrics(pairs, 40, 2).collect()}
    assert found == {r.replicate: pytest.approx(1.0) if r.top < math.inf else math.inf for r in drawn}
    assert math.inf in found.values() and min(found.values()) == pytest.approx(1.0)


def test_no_task_sorts_rows_per_draw(spark):
    """Rows and added draws are dealt by piece into a counted number of tasks; names of models stay behind."""
    pairs = spark.range(0, 600).select(F.col("id").alias("row_ix"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), F.col("id").cast("double").alias("truth"), F.lit(1.0).alias("estimate"))
    plan = bootstrap_metrics(pairs, 20, 1, by=["model"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("REPARTITION_BY_NUM") >= 2
