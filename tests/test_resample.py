from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resamplia.operators.checks import is_dense, replicate_sizes
from resamplia.operators.resample import (
    MARGIN,
    draws,
    poisson_thresholds,
    scan,
    scan_rate,
    with_poisson_weight,
)
from resamplia.sources.pairs import dense_index


def hash63(*values):
    h = 42
    for value in values:
        h = xxhash.xxh64(value.to_bytes(8, "little"), seed=h).intdigest()
    return h >> 1


def test_draws_are_the_hash(spark):
    found = Counter((r.replicate, r.row_ix) for r in draws(spark, 13, 4, 99).collect())
    expected = Counter((b + 1, hash63(99, b * 13 + j) % 13) for b in range(4) for j in range(13))
    assert found == expected


def test_later_replicates_alone(spark):
    every = draws(spark, 50, 9, 5).where("replicate >= 7")
    some = draws(spark, 50, 9, 5, first=7)
    assert Counter(map(tuple, every.collect())) == Counter(map(tuple, some.collect()))


@pytest.mark.parametrize("arguments", [(0, 5, 1), (5, 0, 1), (2**62, 2, 1), (5, 2, 1, 3)])
def test_refused(spark, arguments):
    with pytest.raises(ValueError):
        draws(spark, *arguments)


def test_draws_are_uniform(spark):
    size, times = 100, 2000
    counts = [r.n for r in draws(spark, size, times, 3).groupBy("row_ix").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == size
    chi = sum((n - times) ** 2 / times for n in counts)
    assert abs(chi - (size - 1)) < 5 * math.sqrt(2 * (size - 1))


@given(st.floats(0.001, 1.0))
@settings(max_examples=30, deadline=None)
def test_poisson_thresholds(rate):
    limits = poisson_thresholds(rate)
    assert limits == sorted(set(limits)) and limits[-1] < 2**63
    total = 0.0
    for k, limit in enumerate(limits):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        assert limit / 2**63 == pytest.approx(total, abs=1e-12)
    assert 2**63 - limits[-1] < 10


def test_poisson_weights(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_ix"))
    weights = with_poisson_weight(rows, 1.0, 1, 200, 11)
    n, total, square = weights.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    cells = 200_000
    assert n / cells == pytest.approx(1 - math.exp(-1), abs=0.01)
    assert total / cells == pytest.approx(1.0, abs=0.015)
    assert square / cells == pytest.approx(2.0, abs=0.05)


def pairs_of(spark, size):
    return spark.range(size).select(
        F.col("id").alias("row_ix"),
        F.col("id").cast("double").alias("truth"),
        (F.col("id") + 1).cast("double").alias("estimate"),
    )


@pytest.mark.parametrize("size", [1, 40, 1000, 5000])
def test_scan_draws_exactly_n(spark, size):
    sets = scan(pairs_of(spark, size), size, 30, 17)
    found = {(r.replicate, r.n) for r in replicate_sizes(sets).collect()}
    assert found == {(b, size) for b in range(1, 31)}


def test_scan_is_multinomial(spark):
    """Counts of one row over replicates have the binomial mean and variance."""
    size, times = 400, 500
    sets = scan(pairs_of(spark, size), size, times, 23)
    assert 0 < scan_rate(size) < 1
    counts = sets.groupBy("replicate", "row_ix").agg(F.count("*").alias("n"))
    total, square = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    cells = size * times
    assert total == cells
    assert square / cells - 1 == pytest.approx(1 - 1 / size, abs=0.03)
    per_row = [r.n for r in sets.groupBy("row_ix").agg(F.count("*").alias("n")).collect()]
    chi = sum((n - times) ** 2 / times for n in per_row)
    assert abs(chi - (size - 1)) < 5 * math.sqrt(2 * (size - 1))


def test_scan_leaves_a_margin():
    for size in (64, 256, 1000, 10**6, 10**12):
        missing = size * (1 - scan_rate(size))
        assert missing >= MARGIN * math.sqrt(size) * 0.999
        assert missing <= 2 * MARGIN * math.sqrt(size) * 1.001
    assert scan_rate(1) == scan_rate(100) == 0.0


def test_scan_does_not_depend_on_partitions(spark):
    size = 300
    one = scan(pairs_of(spark, size).repartition(1), size, 5, 4)
    many = scan(pairs_of(spark, size).repartition(7), size, 5, 4)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, many.collect()))


def test_dense_index(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).where("id % 3 != 0").select((F.col("id") * 10).alias("x"))
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    indexed = dense_index(df)
    assert is_dense(indexed) and indexed.columns == ["x", "row_ix"]
    assert sorted(r.x for r in indexed.collect()) == sorted(r.x for r in df.collect())
    one = {(r.x, r.row_ix) for r in indexed.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert {(r.x, r.row_ix) for r in dense_index(spark.read.parquet(str(tmp_path / "t"))).collect()} == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert is_dense(dense_index(df.select(F.lit("a").alias("y"))))
    assert not is_dense(spark.createDataFrame([(0,), (0,), (2,)], "row_ix long"))


def test_weights_of_several_replicates_at_once(spark):
    from resamplia.operators.resample import PoissonWeights

    rows = [5, 3, 1_000_000_007, 40]
    found = PoissonWeights(0.75, 9, 0, 0, np.array(rows)).matrix(4, 3004)
    table = spark.createDataFrame([(r,) for r in rows], "row_ix long")
    want = {(r["replicate"], r["row_ix"]): r["w"] for r in with_poisson_weight(table, 0.75, 4, 3003, 9).collect()}
    assert {(4 + b, rows[i]): int(found[b, i]) for b, i in zip(*np.nonzero(found))} == want


def test_draws_of_a_row_are_in_one_task(spark):
    """Groups by row_ix need no shuffle, and copies of a row in a set are numbered from 1."""
    sets = scan(pairs_of(spark, 500), 500, 20, 8, copy="copy")
    grouped = sets.groupBy("row_ix").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 1).alias("replicates"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(")]
    drawn = sets.collect()
    copies = Counter((r.replicate, r.row_ix) for r in drawn)
    assert sorted((r.replicate, r.row_ix, r.copy) for r in drawn) == sorted((*k, c) for k, n in copies.items() for c in range(1, n + 1))
    assert {r.row_ix: r.replicates for r in grouped.collect()} == Counter(k[1] for k in copies)


def test_tables_are_broadcast_in_parts(spark):
    from resamplia.operators.resample import gather

    found = [Counter(map(tuple, gather(pairs_of(spark, 101), 101, 6, 3, parts=k).collect())) for k in (0, 1, 4)]
    assert found[0] == found[1] == found[2] and found[0].total() == 606
