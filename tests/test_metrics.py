from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resamplia.functions.metrics import (
    METRICS,
    complete_pairs,
    metric_aggregates,
    metrics_from_sums,
    to_long,
    weighted_sums,
)
from resamplia.operators import ordered
from resamplia.operators.ordered import roc_auc

SCHEMA = "truth double, estimate double"


def score(spark, rows):
    pairs = complete_pairs(spark.createDataFrame(rows, SCHEMA))
    return pairs.agg(*metric_aggregates()).first().asDict()


def weighted_score(spark, rows):
    """The same through weighted sums, every row with weight 1."""
    known = [row for row in rows if None not in row and not any(map(math.isnan, row))]
    cy = sum(r[0] for r in known) / len(known)
    cp = sum(r[1] for r in known) / len(known)
    sums = complete_pairs(spark.createDataFrame(rows, SCHEMA)).agg(
        *weighted_sums(
            F.lit(1.0), F.col("truth") - cy, F.col("estimate") - cp, F.col("truth") - F.col("estimate")
        )
    )
    return sums.select(*metrics_from_sums(F.lit(cy - cp))).first().asDict()


CASES = {
    "perfect": ([(1, 1), (2, 2), (3, 3)], dict(rmse=0, rsq=1, mae=0, ccc=1)),
    "shifted": ([(1, 2), (2, 3), (3, 4)], dict(rmse=1, rsq=1, mae=1, ccc=2 / 3)),
    "constant_truth": ([(1, 2), (1, 3)], dict(rmse=math.sqrt(2.5), rsq=None, mae=1.5, ccc=0)),
    "constant_fraction": ([(0.1, 2), (0.1, 3), (0.1, 5)], dict(rsq=None, ccc=0)),
    "one_row": ([(1, 2)], dict(rmse=1, rsq=None, mae=1, ccc=None)),
    "with_nulls": ([(1, 1), (None, 2), (3, None), (2, 2)], dict(rmse=0, rsq=1, mae=0, ccc=1)),
    "with_nan": ([(1, 1), (float("nan"), 2), (3, float("nan")), (2, 2)], dict(rmse=0, rsq=1, mae=0, ccc=1)),
    "opposite": ([(1, 3), (2, 2), (3, 1)], dict(rsq=1, ccc=-1)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("method", [score, weighted_score])
def test_hand_computed(spark, name, method):
    rows, expected = CASES[name]
    found = method(spark, [tuple(None if v is None else float(v) for v in r) for r in rows])
    for metric, value in expected.items():
        assert found[metric] == (None if value is None else pytest.approx(value, abs=1e-12))


def test_large_mean_keeps_precision(spark):
    rows = [(1e8 + i, 1e8 + i + (i % 3) * 0.1) for i in range(1000)]
    found = score(spark, rows)
    assert 0.99999 < found["rsq"] <= 1.0
    assert weighted_score(spark, rows)["rsq"] == pytest.approx(found["rsq"], abs=1e-9)


def test_no_rows(spark):
    assert set(score(spark, [(None, None)]).values()) == {None}


def test_long_form(spark):
    schema = "replicate int, rmse double, rsq double, mae double, ccc double"
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None)], schema)
    rows = to_long(wide, ["replicate"]).collect()
    assert [r.metric for r in rows] == list(METRICS)
    assert [r.estimate for r in rows] == [1.0, 2.0, 3.0, None]
    assert {r.estimator for r in rows} == {"standard"}


def numpy_metrics(truth, estimate):
    y, p = np.array(truth), np.array(estimate)
    error = y - p
    found = {"rmse": math.sqrt((error**2).mean()), "mae": np.abs(error).mean(), "rsq": None, "ccc": None}
    if len(y) > 1:
        cov = ((y - y.mean()) * (p - p.mean())).sum() / (len(y) - 1)
        if len(set(truth)) > 1 and len(set(estimate)) > 1:
            found["rsq"] = cov**2 / (y.var(ddof=1) * p.var(ddof=1))
        below = y.var(ddof=1) + p.var(ddof=1) + (y.mean() - p.mean()) ** 2
        found["ccc"] = 2 * cov / below if below > 0 else None
    return found


def test_random_groups_against_numpy(spark):
    """200 groups of 1 to 40 rows: continuous, coarse and constant columns."""
    draw = np.random.default_rng(5)
    groups = {}
    for group in range(200):
        n = int(draw.integers(1, 41))
        truth = draw.normal(10, 3, n) if group % 3 else draw.integers(0, 3, n).astype(float)
        estimate = truth + draw.normal(0, 1, n) if group % 5 else np.full(n, 0.3)
        groups[group] = (truth.tolist(), estimate.tolist())
    rows = [(g, t, e) for g, (ts, es) in groups.items() for t, e in zip(ts, es)]
    df = spark.createDataFrame(rows, "g int, truth double, estimate double").repartition(6)
    for row in df.groupBy("g").agg(*metric_aggregates()).collect():
        expected = numpy_metrics(*groups[row.g])
        for metric in METRICS:
            want = expected[metric]
            assert row[metric] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-12))


def brute_auc(rows):
    wins = [
        1.0 if a > b else 0.5 if a == b else 0.0
        for t, a in rows
        if t == 1
        for u, b in rows
        if u == 0
    ]
    return sum(wins) / len(wins)


def test_auc_against_all_pairs(spark):
    # A third of all rows share one score.
    rows = [(i * 7 % 5 % 2, 1.5 if i % 3 == 0 else (i * 37 % 101) / 4) for i in range(600)]
    df = spark.createDataFrame(rows, "truth int, score double")
    found = roc_auc(df, "truth", "score").first()
    assert found.roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 1])
def test_auc_with_many_ranges(spark, rows_per_range, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", rows_per_range)
    rows = [(i * 7 % 5 % 2, float(i * 31 % 457) ** 2) for i in range(900)]
    rows += [(0, float("inf")), (1, float("inf")), (0, float("-inf")), (1, float("nan"))]
    df = spark.createDataFrame(rows, "truth int, score double")
    assert roc_auc(df, "truth", "score").first().roc_auc == pytest.approx(brute_auc(rows[:-1]), abs=1e-12)


def test_auc_per_group(spark):
    rows = [(i % 4, i * 7 % 5 % 2, float(i * 31 % 57)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, truth int, score double")
    found = {r.g: r.roc_auc for r in roc_auc(df, "truth", "score", ["g"]).collect()}
    for g in range(4):
        assert found[g] == pytest.approx(brute_auc([r[1:] for r in rows if r[0] == g]), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "truth int, score double")
    assert roc_auc(df, "truth", "score").first().roc_auc is None


def test_auc_of_no_rows(spark):
    df = spark.createDataFrame([], "truth int, score double")
    assert roc_auc(df, "truth", "score").first().roc_auc is None
