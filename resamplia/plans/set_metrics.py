"""Metrics of your own over bootstrap resamples, from states that merge (`functions.states`).

    mean_error = SumMetric(["error"], lambda rows, w: [w.sum(), (w * abs(rows["truth"] - rows["estimate"])).sum()],
                           lambda s: {"error": s[1] / s[0]})
    set_metrics(pairs, times=5000, seed=1, metric=mean_error)      # one row per replicate

The draws are those of `plans.bootstrap` for the same seed. A task gets some rows and some replicates; it makes the weights of the
rows for each of these replicates itself and hands the function distinct rows with weights. No drawn row is stored, shuffled or
sent to Python; what is shuffled is a copy of each row for each group of replicates, the draws that complete a replicate
(8 to 16 times the root of its size), and the states. States of a set are merged FAN at a time, level by level.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resamplia.functions.metrics import complete_pairs
from resamplia.functions.states import Ask, Mergeable, SetMetric
from resamplia.operators.joins import inner_join_nulls_match, kept
from resamplia.operators.resample import PoissonWeights, scan_rate, scan_top_up, task_count
from resamplia.operators.store import stored
from resamplia.plans.bootstrap import checked_models, frame_of

# Rows of a task's table, replicates that one task scores, draws it is sent at most, and states that are merged at a time.
PIECE_ROWS, PIECE_SETS, PIECE_DRAWS, FAN = 1 << 18, 2500, 1_000_000, 32

# States that one task merges, about.
TASK_STATES = 50_000


def _unit(metric: SetMetric, by: list[str], columns: list[str], schema: pa.Schema, rate: float, seed: int, span: int, size: int):
    """Rows of one piece, and the replicates (without row_ix) and added draws (with row_ix) of one group: a state for each
    replicate and model."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {name: [] for name in ("first", "replicate", "state")}
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        low = rows["_piece"][0].as_py() * span
        weights = PoissonWeights(rate, seed, low, min(low + span, size))
        place = rows["row_ix"].to_numpy() - low
        values = {c: rows[c].to_numpy(zero_copy_only=False) for c in columns}
        names = list(zip(*[rows[c].to_pylist() for c in by], strict=True)) if by else [()] * rows.num_rows
        of: dict[tuple, list[int]] = {}
        for i, name in enumerate(names):
            of.setdefault(name, []).append(i)
        models = {name: np.array(i) for name, i in of.items()}
        # What many replicates share is worked out once.
        prepared = {name: metric.prepare({c: v[at] for c, v in values.items()}) for name, at in models.items()}
        single = asked.filter(asked["row_ix"].is_valid())
        order = np.argsort(single["replicate"].to_numpy(), kind="stable")
        drawn, extra = single["replicate"].to_numpy()[order], single["row_ix"].to_numpy()[order] - low
        sets = asked.filter(asked["row_ix"].is_null()).sort_by("replicate")
        keys = list(zip(*[sets[f"_of_{c}"].to_pylist() for c in by], strict=True)) if by else [()] * sets.num_rows
        now, weight = None, None
        for replicate, key, question in zip(sets["replicate"].to_pylist(), keys, sets["_question"].to_pylist(), strict=True):
            if key not in models:
                continue
            if replicate != now:
                now, weight = replicate, weights.of(replicate)
                mine = extra[np.searchsorted(drawn, replicate) : np.searchsorted(drawn, replicate, "right")]
                weight += np.bincount(mine, minlength=len(weight))
            w = weight[place[models[key]]]
            hit = np.flatnonzero(w)
            if len(hit):
                at, asking = models[key][hit], pickle.loads(question) if question else None
                if prepared[key] is None:
                    state = metric.update({c: v[at] for c, v in values.items()}, w[hit], asking)
                else:
                    state = metric.weigh(prepared[key], w, asking)
                out["first"].append(models[key][0])
                out["replicate"].append(replicate)
                out["state"].append(pickle.dumps(state))
        taken = [rows[c].combine_chunks().take(pa.array(out["first"], pa.int64())) for c in by]
        piece = pa.array(rows["_piece"].to_pylist()[:1] * len(out["first"]), pa.int64())
        return pa.Table.from_arrays([pa.array(out["replicate"], pa.int64()), *taken, piece, pa.array(out["state"], pa.binary())], schema=schema)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], metric: Mergeable) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys, with the merged state."""
    last, key, state = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*last.columns, pa.array([pickle.dumps(state)], pa.binary())], [*keys, "state"])

    for batch in batches:
        names = zip(*[batch.column(c).to_pylist() for c in keys], strict=True)
        for i, (name, blob) in enumerate(zip(names, batch.column("state").to_pylist(), strict=True)):
            if last is not None and name == key:
                state = metric.merge(state, pickle.loads(blob))
                continue
            if last is not None:
                yield done()
            last, key, state = batch.slice(i, 1).select(keys), name, pickle.loads(blob)
    if last is not None:
        yield done()


def merge_states(states: DataFrame, metric: Mergeable, by: Sequence[str], pieces: int, sets: int = 1) -> DataFrame:
    """(by, state) from the states (by, _piece, state) of the pieces 0..pieces-1, FAN pieces at a time; `sets` is the number of keys, if
    it is known and large."""
    keys = [*by, "_piece"]
    spark, schema = states.sparkSession, T.StructType([states.schema[c] for c in (*keys, "state")])
    while pieces > 1:
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(sets * pieces / TASK_STATES))
        pieces = ceil(pieces / FAN)
        grouped = states.withColumn("_piece", F.expr(f"_piece div {FAN}").cast("bigint"))
        dealt = grouped.repartition(tasks, *keys)
        states = dealt.sortWithinPartitions(*keys).select(*schema.fieldNames()).mapInArrow(lambda b: _runs(b, keys, metric), schema)
    return states.drop("_piece")


def _finish(metric: SetMetric, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, again = {name: [] for name in metric.names}, []
            for state, question in zip(batch.column("state").to_pylist(), batch.column("_question").to_pylist(), strict=True):
                found = metric.finish(pickle.loads(state) if state else None, pickle.loads(question) if question else None)
                asks = isinstance(found, Ask)
                again.append(pickle.dumps(found.question) if asks else None)
                for name in metric.names:
                    value = None if asks else found[name]
                    values[name].append(None if value is None else float(value))
            results = [pa.array(v, pa.float64()) for v in values.values()]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *results, pa.array(again, pa.binary())], [*keys, *metric.names, "_question"])

    return run


def set_metrics(pairs: DataFrame, times: int, seed: int, metric: SetMetric, by: Sequence[str] = (), first: int = 1) -> DataFrame:
    """One row for every replicate first..times and model: the metric of that resample.

    `pairs` is as for `bootstrap_metrics`; further numeric columns reach the metric too. Draws of rows without truth or estimate are
    left out. Rounds that the metric asks for are passes over the rows for the replicates that still need them.
    """
    spark, by = pairs.sparkSession, list(by)
    columns = [c for c in pairs.columns if c != "row_ix" and c not in by]
    models, rows, size = checked_models(pairs, by)
    rate, sets = scan_rate(size), times - first + 1
    span = max(1, PIECE_ROWS * size // rows)
    pieces = ceil(size / span)
    added = int(sets * (1.0 - rate) * size)
    groups = max(ceil(sets / PIECE_SETS), ceil(added / (pieces * PIECE_DRAWS)), ceil(task_count(spark, rows * sets, 400_000_000) / pieces))
    groups = min(groups, sets)
    group = F.expr(f"(replicate - {first}) * {groups} div {sets}").alias("_group")
    data = complete_pairs(pairs).select(
        "row_ix", *by, *columns, F.expr(f"row_ix div {span}").alias("_piece"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("_group")
    )
    draws = kept(scan_top_up(spark, size, times, seed, first))
    keys, names = ["replicate", *by], list(metric.names)
    kinds = {f.name: f for f in pairs.schema.fields}
    key_fields = [T.StructField("replicate", T.LongType()), *[kinds[c] for c in by]]
    state_schema = T.StructType([*key_fields, T.StructField("_piece", T.LongType()), T.StructField("state", T.BinaryType())])
    result_schema = T.StructType([*key_fields, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("_question", T.BinaryType())])
    unit = _unit(metric, by, columns, to_arrow_schema(state_schema), rate, seed, span, size)
    open_sets = frame_of(models, by, first, times).withColumn("_question", F.lit(None).cast("binary"))
    done: DataFrame | None = None
    while True:
        # Other names: both sides of the grouping come from `pairs`.
        wanted = open_sets.select(
            "replicate", *[F.col(c).alias(f"_of_{c}") for c in by], "_question", F.lit(None).cast("bigint").alias("row_ix"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))).alias("_piece"), group,
        )
        own = draws if done is None else draws.join(open_sets.select("replicate").distinct(), "replicate", "left_semi")
        sent = own.select("replicate", "row_ix", F.expr(f"row_ix div {span}").alias("_piece"), group)
        asked = wanted.unionByName(sent, allowMissingColumns=True)
        # Twice the units: few partitions get several of them.
        left, right = (d.repartition(2 * pieces * groups, "_piece", "_group").groupBy("_piece", "_group") for d in (data, asked))
        states = merge_states(left.cogroup(right).applyInArrow(unit, state_schema), metric, keys, pieces, sets * (rows // size))
        met = inner_join_nulls_match(open_sets, states, keys, "left")
        # A row per set: few. Stored, so that no round runs again and none carries the plans of those before.
        found = stored(met.select(*keys, "_question", "state").mapInArrow(_finish(metric, keys), result_schema))
        now = found.where("_question is null").select(*keys, *names)
        done = now if done is None else done.unionByName(now)
        open_sets = found.where("_question is not null").select(*keys, "_question")
        if open_sets.limit(1).count() == 0:
            draws.unpersist()
            models.unpersist()
            return done
