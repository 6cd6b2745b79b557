"""User metrics over whole sets, from states that merge."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resamplia.functions.states import Ask, QuantileMetric, SumMetric
from resamplia.operators.resample import PoissonWeights, with_poisson_weight
from resamplia.plans import set_metrics as module
from resamplia.plans.bootstrap import analysis_sets
from resamplia.plans.set_metrics import merge_states, set_metrics


def pairs_of(spark, n, models=("a", "b", None)):
    rows = [(i, m, float(i % 37) if (i + (m == "b")) % 11 else None, float(i * 7 % 41), i % 5) for i in range(n) for m in models]
    return spark.createDataFrame(rows, "row_ix long, model string, truth double, estimate double, extra int").repartition(4)


def by_hand(pairs, times, seed, by, function):
    found = {}
    for r in analysis_sets(pairs, times, seed, by).collect():
        found.setdefault((r["replicate"], *(r[c] for c in by)), []).append(r)
    return {k: function(v) for k, v in found.items()}


def error_sum():
    return SumMetric(["total", "n"], lambda rows, w: [(w * rows["extra"]).sum(), w.sum()], lambda s: {"total": s[0], "n": s[1]})


@pytest.mark.parametrize("rate", [0.5, 1 - 2**-6, 1.0])
def test_weights_in_numpy_are_those_of_the_plan(spark, rate):
    rows = spark.range(50, 250).select(F.col("id").alias("row_ix"))
    want = {(r["replicate"], r["row_ix"]): r["w"] for r in with_poisson_weight(rows, rate, 3, 9, 12).collect()}
    own = PoissonWeights(rate, 12, 50, 250)
    got = {(b, 50 + i): int(w) for b in range(3, 10) for i, w in enumerate(own.of(b)) if w}
    assert got == want


@pytest.mark.parametrize(("n", "piece", "sets"), [(30, 1 << 16, 500), (2000, 1 << 16, 500), (2000, 90, 3)])
def test_sums_equal_drawn_rows(spark, monkeypatch, n, piece, sets):
    monkeypatch.setattr(module, "PIECE_ROWS", piece)
    monkeypatch.setattr(module, "PIECE_SETS", sets)
    monkeypatch.setattr(module, "FAN", 4)
    pairs = pairs_of(spark, n)
    got = {(r["replicate"], r["model"]): (r["total"], r["n"]) for r in set_metrics(pairs, 11, 5, error_sum(), ["model"], first=4).collect()}
    want = by_hand(pairs, 11, 5, ["model"], lambda rows: (sum(r["extra"] for r in rows), len(rows)))
    assert got == {k: v for k, v in want.items() if k[0] >= 4} and len(got) == 8 * 3


def test_one_replicate_is_many_tasks(spark, monkeypatch):
    """No task holds a whole set: states of 40 pieces are merged four at a time."""
    monkeypatch.setattr(module, "PIECE_ROWS", 50)
    monkeypatch.setattr(module, "FAN", 4)
    pairs = pairs_of(spark, 2000, ["a"]).drop("model")
    largest = SumMetric(["n"], lambda rows, w: [float(len(w))], lambda s: {"n": s[0]})
    seen = []
    whole = module._unit

    def watched(metric, *rest):
        seen.append(rest[4:])
        return whole(metric, *rest)

    monkeypatch.setattr(module, "_unit", watched)
    distinct = set_metrics(pairs, 1, 5, largest).first()["n"]
    assert seen[0][-2:] == (50, 2000)
    drawn = analysis_sets(pairs, 1, 5)
    assert distinct == drawn.select("row_ix").distinct().count()
    median = QuantileMetric("m", lambda rows: rows["truth"])
    median.FEW = 2
    values = sorted(r["truth"] for r in drawn.collect())
    assert set_metrics(pairs, 1, 5, median).first()["m"] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_quantiles_by_rounds(spark):
    pairs = pairs_of(spark, 600)
    for q in (0.5, 0.025):
        metric = QuantileMetric("q", lambda rows: rows["truth"] - rows["estimate"], q)
        metric.FEW, metric.BITS = 5, 7
        got = {(r["replicate"], r["model"]): r["q"] for r in set_metrics(pairs, 6, 2, metric, ["model"]).collect()}
        want = by_hand(pairs, 6, 2, ["model"], lambda rows, q=q: float(np.quantile([r["truth"] - r["estimate"] for r in rows], q)))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def one_at_a_time(metric, values, weights, cut):
    question = None
    while True:
        parts = [(values[:cut], weights[:cut]), (values[cut:], weights[cut:])]
        states = [metric.update({"v": v}, w, question) for v, w in parts if len(v)]
        found = metric.finish(states[0] if len(states) == 1 else metric.merge(*states), question)
        if not isinstance(found, Ask):
            return found["x"]
        question = found.question


def test_quantile_states_of_odd_values():
    rng = np.random.default_rng(3)
    for trial in range(120):
        n = int(rng.integers(1, 300))
        q = [0.5, 0.025, 0.975, 0.0, 1.0][trial % 5]
        values = [rng.normal(size=n), rng.integers(-2, 3, n) + 0.0, np.full(n, 7.5), rng.normal(size=n) * 1e300, np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), np.where(rng.random(n) < 0.5, -0.0, 0.0)][trial % 6]
        weights = rng.integers(1, 4, n)
        metric = QuantileMetric("x", lambda rows: rows["v"], q)
        metric.FEW, metric.BITS = [4096, 3, 1][trial % 3], [16, 5][trial % 2]
        whole = np.repeat(values, weights)
        whole = whole[~np.isnan(whole)]
        got = one_at_a_time(metric, values, weights, int(rng.integers(0, n + 1)))
        assert got is None if not len(whole) else got == pytest.approx(float(np.quantile(whole, q)), rel=1e-12)
    infinite = QuantileMetric("x", lambda rows: rows["v"])
    assert one_at_a_time(infinite, np.array([-np.inf, 1.0, np.inf]), np.array([1, 1, 5]), 2) == math.inf


def test_sets_without_usable_rows_are_there(spark):
    rows = [(i, m, 1.0 if m == "all" or (m == "one" and i == 3) else None, 2.0) for i in range(80) for m in ("all", "one", "none")]
    pairs = spark.createDataFrame(rows, "row_ix long, model string, truth double, estimate double")
    count = SumMetric(["n"], lambda rows, w: [w.sum()], lambda s: {"n": s[0]})
    found = {(r["replicate"], r["model"]): r["n"] for r in set_metrics(pairs, 40, 1, count, ["model"]).collect()}
    assert len(found) == 120
    assert all(found[b, "all"] == 80 and found[b, "none"] is None for b in range(1, 41))
    assert {found[b, "one"] is None for b in range(1, 41)} == {True, False}
    with pytest.raises(ValueError):
        set_metrics(pairs.limit(0), 3, 1, count, ["model"])


def test_states_merge_level_by_level(spark, monkeypatch):
    import pickle

    monkeypatch.setattr(module, "FAN", 3)
    metric = SumMetric(["s"], None, lambda s: {"s": s[0]})
    rows = [(b, m, p, pickle.dumps([float(p)])) for b in (1, 2) for m in ("x", None) for p in range(29) if p % 7]
    states = spark.createDataFrame(rows, "replicate long, model string, _piece long, state binary").repartition(5)
    merged = merge_states(states, metric, ["replicate", "model"], 29)
    assert {(r["replicate"], r["model"]): pickle.loads(r["state"]) for r in merged.collect()} == {(b, m): [sum(p for p in range(29) if p % 7) + 0.0] for b in (1, 2) for m in ("x", None)}


def test_nothing_depends_on_partitions(spark):
    pairs = pairs_of(spark, 300)
    one = set_metrics(pairs.repartition(1), 5, 3, error_sum(), ["model"]).collect()
    many = set_metrics(pairs.repartition(9), 5, 3, error_sum(), ["model"]).collect()
    assert sorted(one, key=repr) == sorted(many, key=repr)


def test_rounds_end_at_one_value():
    """Many draws of one value: the second round knows that it is the only one there."""
    metric = QuantileMetric("x", lambda rows: rows["v"])
    rows, weight = {"v": np.array([1.0, 37.25, 900.0])}, np.array([100_000, 300_001, 100_000])
    asked = metric.finish(metric.update(rows, weight, None), None)
    half = metric.merge(metric.update(rows, weight // 2, asked.question), metric.update(rows, weight - weight // 2, asked.question))
    assert metric.finish(half, asked.question) == {"x": 37.25}
