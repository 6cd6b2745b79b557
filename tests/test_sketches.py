"""Quantile sketches: what they enclose, and the error they state."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resamplia.functions.sketch import Sketch
from resamplia.plans import set_metrics
from resamplia.plans.bootstrap import percentile_ci
from resamplia.plans.sketches import percentile_bounds, quantile_bounds

QUANTILES = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]


def check(sketch, values):
    values = np.sort(values)
    assert sketch.n == len(values)
    for q in QUANTILES:
        low, high = sketch.bounds(q)
        exact = float(np.quantile(values, q)) if np.isfinite(values).all() else values[round((len(values) - 1) * q)]
        assert low <= exact <= high or low == pytest.approx(exact, rel=1e-12) or high == pytest.approx(exact, rel=1e-12)
        # Neither is further off than twice the error and the weight of a number.
        slack = 2 * sketch.error + 2 ** len(sketch.buffers)
        assert np.searchsorted(values, low, "right") >= (len(values) - 1) * q - slack
        assert np.searchsorted(values, high, "left") <= (len(values) - 1) * q + 1 + slack


@pytest.mark.parametrize("kind", ["random", "sorted", "falling", "ties", "two"])
def test_enclosed_in_any_order_and_any_merge(kind):
    rng = np.random.default_rng(5)
    values = {
        "random": rng.normal(size=20_000), "sorted": np.arange(20_000.0), "falling": -np.arange(20_000.0),
        "ties": rng.integers(0, 9, 20_000).astype(float), "two": np.where(rng.random(20_000) < 0.03, 5.0, -1e300),
    }[kind]
    check(Sketch(64).add(values), values)
    parts = [Sketch(64).add(p) for p in np.split(values, [10, 500, 501, 9_000, 15_000])]
    random.Random(2).shuffle(parts)
    while len(parts) > 1:
        parts.append(parts.pop(0).merge(parts.pop(0)))
    check(parts[0], values)


def test_error_and_size_are_as_stated():
    n, size = 200_000, 256
    sketch = Sketch(size).add(np.random.default_rng(1).normal(size=n))
    assert sketch.error <= n * math.ceil(math.log2(n / size)) / size + size
    assert sum(map(len, sketch.buffers)) < size * len(sketch.buffers) and len(sketch.buffers) < 13
    small = Sketch(1000).add(np.arange(900.0))
    assert small.error == 0 and small.bounds(0.5) == (449.0, 450.0)


def test_nulls_nan_infinite_and_none():
    assert Sketch(8).bounds(0.5) is None
    assert Sketch(8).add(np.array([np.nan, np.nan])).bounds(0.5) is None
    assert Sketch(8).add(np.array([np.nan, 3.0])).bounds(0.5) == (3.0, 3.0)
    check(Sketch(8).add(np.array([-np.inf] * 30 + [1.0] * 30 + [np.inf] * 60)), np.array([-np.inf] * 30 + [1.0] * 30 + [np.inf] * 60))


def test_bounds_per_key(spark, monkeypatch):
    monkeypatch.setattr(set_metrics, "FAN", 3)
    frame = spark.range(0, 30_000, 1, 9).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("metric"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 7919 % 10_007).cast("double")).alias("estimate"),
    )
    frame = frame.withColumn("metric", F.when(F.col("metric") != "k4", F.col("metric")))
    exact = {r["metric"]: r for r in percentile_ci(frame).collect()}
    found = percentile_bounds(frame, size=64).collect()
    assert {r["metric"] for r in found} == exact.keys() and None in exact
    for r in found:
        e = exact[r["metric"]]
        assert r["replicates"] == e["replicates"]
        assert r["lower"]["low"] <= e["lower"] <= r["lower"]["high"] and r["upper"]["low"] <= e["upper"] <= r["upper"]["high"]
        assert r["rank_error"] <= math.ceil(math.log2(max(2, r["replicates"] / 64))) / 64 + 64 / r["replicates"]
    whole = quantile_bounds(frame, "estimate", [0.5], [], 64).collect()
    assert len(whole) == 1 and whole[0]["n"] == frame.where("estimate is not null").count()


def test_no_task_gets_the_values_of_a_key(spark):
    """Only states are moved: the values are summarized where they are read."""
    frame = spark.range(0, 1000, 1, 4).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("estimate"))
    plan = percentile_bounds(frame)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert plan.count("Exchange") == 2 and "MapInArrow" in below


def test_empty(spark):
    frame = spark.createDataFrame([], "metric string, estimate double")
    assert percentile_bounds(frame).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", float("nan"))], "metric string, estimate double")
    row = percentile_bounds(nulls).first()
    assert row["replicates"] == 0 and row["lower"]["low"] is None and row["rank_error"] is None
