"""DuckDB SQL with the same result as each query of `fixtures.queries`.

Random draws are checked too: `hash63` writes the 64-bit hash (XXH64 of an 8-byte integer) as
SQL arithmetic, chained over several integers as Spark's xxhash64 does.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from fixtures.views import BATCH_TIMES_SQL, MONITOR_SQL, PAIRS_SQL, RESULTS_SQL

# The five primes of XXH64, and the seed that Spark's xxhash64 starts from.
PRIME_1 = 11400714785074694791
PRIME_2 = 14029467366897019727
PRIME_3 = 1609587929392839161
PRIME_4 = 9650029242287828579
PRIME_5 = 2870177450012600261
START = 42

WORD = 2**64

# Last counter of the hashes of added draws.
ADDED = 1


def poisson_limits(rate: str) -> list[int]:
    """2^63 times P(X <= k), rounded down, for k = 0, 1, ... while that is below 2^63 - 1: a hash below the first of
    them stands for 0, and so on. exp(-rate) is summed up as a series."""
    with localcontext() as context:
        context.prec = 60
        x, power, base = Decimal(rate), Decimal(1), Decimal(0)
        for i in range(1, 80):
            base += power
            power *= -x / i
        limits, term, below = [], base, base
        while int(below * 2**63) not in (2**63, *limits[-1:]):
            limits.append(int(below * 2**63))
            term *= x / len(limits)
            below += term
    return limits


def _times(value: str, factor: int) -> str:
    return f"(({value})::UHUGEINT * {factor}::UHUGEINT & {WORD - 1}::UHUGEINT)::UBIGINT"


def _plus(value: str, term: int) -> str:
    return f"((({value})::UHUGEINT + {term}::UHUGEINT) & {WORD - 1}::UHUGEINT)::UBIGINT"


def _rotate(value: str, bits: int) -> str:
    return f"((({value} & {2 ** (64 - bits) - 1}::UBIGINT) << {bits}) | ({value} >> {64 - bits}))"


def hash63(source: str, target: str, counters: list[str]) -> str:
    """CTEs that extend relation `source` by u, the hash of the counters shifted right by one."""
    steps = [f"{target}_0 AS (SELECT *, {START}::UBIGINT AS h, 0::UBIGINT AS k FROM {source})"]

    def then(**columns: str) -> None:
        change = ", ".join(f"{value} AS {name}" for name, value in columns.items())
        steps.append(
            f"{target}_{len(steps)} AS (SELECT * REPLACE ({change}) FROM {target}_{len(steps) - 1})"
        )

    for counter in counters:
        then(k=_times(f"({counter})::UBIGINT", PRIME_2))
        then(k=_rotate("k", 31))
        then(h=f"xor({_plus('h', PRIME_5 + 8)}, {_times('k', PRIME_1)})")
        then(h=_rotate("h", 27))
        then(h=_plus(_times("h", PRIME_1), PRIME_4))
        then(h=_times("xor(h, h >> 33)", PRIME_2))
        then(h=_times("xor(h, h >> 29)", PRIME_3))
        then(h="xor(h, h >> 32)")
    steps.append(
        f"{target} AS (SELECT * EXCLUDE (h, k), (h >> 1)::BIGINT AS u FROM {target}_{len(steps) - 1})"
    )
    return ",\n".join(steps)


P = f"p AS ({PAIRS_SQL})"
R = f"raw_r AS ({RESULTS_SQL})"
M = f"raw_m AS ({MONITOR_SQL})"

BACKEND = "CASE WHEN backend = 'foreach' THEN 'multisession' ELSE backend END"
PLATFORM = """CASE platform WHEN 'source' THEN 'unix'
  WHEN 'mac.binary.big-sur-arm64' THEN 'macOS' ELSE platform END"""

RC = f"""{R},
r AS (SELECT * REPLACE ({BACKEND} AS backend, {PLATFORM} AS platform) FROM raw_r)"""
MC = f"""{M},
m AS (SELECT * REPLACE ({PLATFORM} AS platform) FROM raw_m WHERE pct_cpu IS NOT NULL)"""

METRICS = """sqrt(avg((truth - estimate) * (truth - estimate))) AS rmse,
  covar_samp(truth, estimate) * covar_samp(truth, estimate)
    / nullif(var_samp(truth) * var_samp(estimate), 0) AS rsq,
  avg(abs(truth - estimate)) AS mae,
  2 * covar_samp(truth, estimate) / nullif(var_samp(truth) + var_samp(estimate)
    + (avg(truth) - avg(estimate)) * (avg(truth) - avg(estimate)), 0) AS ccc"""

ROUNDED = "round(rmse, 6) AS rmse, round(rsq, 6) AS rsq, round(mae, 6) AS mae, round(ccc, 6) AS ccc"


def long_sql(source: str, keys: str = "") -> str:
    """Metric rows from one column per metric."""
    return " UNION ALL ".join(
        f"SELECT {keys} '{m}' AS metric, 'standard' AS estimator, {m} AS estimate FROM {source}"
        for m in ("rmse", "rsq", "mae", "ccc")
    )


def draws_sql(times: int, seed: int, first: int = 1) -> str:
    """CTE d(replicate, row_ix)."""
    return f"""size AS (SELECT count(*) AS size FROM documents),
counters AS (SELECT b.replicate, size, (b.replicate - 1) * size + doc_id AS id
  FROM documents CROSS JOIN size CROSS JOIN range({first}, {times + 1}) b(replicate)),
{hash63("counters", "hashed", [str(seed), "id"])},
d AS (SELECT replicate, u % size AS row_ix FROM hashed)"""


def sets_sql(times: int, seed: int, first: int = 1, model: str | None = "six_per_word") -> str:
    """CTE s: analysis sets."""
    where = f" WHERE model = '{model}'" if model else ""
    return f"""WITH {P}, {draws_sql(times, seed, first)},
s AS (SELECT replicate, p.* FROM d JOIN p USING (row_ix){where})"""


def scan_sql(times: int, seed: int, first: int = 1, model: str | None = "six_per_word", pairs: str = PAIRS_SQL, rows: str = "SELECT doc_id AS row_ix FROM documents") -> str:
    """CTE s: analysis sets, from weights and single draws."""
    tables = ", ".join(f"({k}, {limit})" for k in range(1, 13) for limit in poisson_limits(str(Decimal(1) - Decimal(1) / 2**k)))
    where = f" WHERE model = '{model}'" if model else ""
    return f"""WITH p AS ({pairs}), ix AS ({rows}), size AS (SELECT count(*) AS size,
  greatest(0, floor(log2(sqrt(count(*)) / 8)))::INT AS k FROM ix),
limits AS (SELECT list(x) AS limits FROM (VALUES {tables}) t(k, x) WHERE k = (SELECT k FROM size)),
counters AS (SELECT row_ix, b.replicate FROM ix CROSS JOIN range({first}, {times + 1}) b(replicate)
  WHERE (SELECT k FROM size) > 0),
{hash63("counters", "hashed", [str(seed), "replicate", "row_ix"])},
weights AS MATERIALIZED (SELECT replicate, row_ix, len(list_filter((SELECT limits FROM limits), lambda x: x <= u)) AS w FROM hashed),
totals AS (SELECT replicate, sum(w)::BIGINT AS drawn FROM weights GROUP BY replicate),
missing AS (SELECT b.replicate, (SELECT size FROM size) - coalesce(drawn, 0) AS missing
  FROM range({first}, {times + 1}) b(replicate) LEFT JOIN totals USING (replicate)),
extra AS (SELECT replicate, unnest(range(1, missing + 1)) AS draw FROM missing),
{hash63("extra", "hashed_extra", [str(seed), "replicate", "draw", str(ADDED)])},
d AS (SELECT replicate, u % (SELECT size FROM size) AS row_ix FROM hashed_extra
  UNION ALL SELECT replicate, row_ix FROM (SELECT *, unnest(range(0, w)) FROM weights WHERE w > 0)),
s AS (SELECT replicate, p.* FROM d JOIN p USING (row_ix){where})"""


RARE_SQL = """
SELECT doc_id AS row_ix, m.model AS model, CAST(n_chars AS DOUBLE) AS truth,
  CASE WHEN m.model = 'six_per_word' OR doc_id % 300 = 0 THEN CAST(6 * len(string_split(text, ' ')) AS DOUBLE) END AS estimate
FROM documents CROSS JOIN (SELECT 'six_per_word' AS model UNION ALL SELECT 'rare') m
"""

LABELLED = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_ix, n_chars AS score, quality AS truth
FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)"""


def poisson_sql(times: int, seed: int) -> str:
    limits = ", ".join(str(limit) for limit in poisson_limits("1"))
    return f"""WITH {P},
counters AS (SELECT doc_id AS row_ix, b.replicate
  FROM documents CROSS JOIN range(1, {times + 1}) b(replicate)),
{hash63("counters", "hashed", [str(seed), "replicate", "row_ix"])},
weights AS (SELECT replicate, row_ix, len(list_filter([{limits}], lambda x: x <= u)) AS w FROM hashed),
s AS (SELECT replicate, p.* FROM (SELECT *, unnest(range(0, w)) FROM weights WHERE w > 0) JOIN p USING (row_ix)),
metrics AS (SELECT replicate, model, {METRICS}, count(*) AS n FROM s GROUP BY replicate, model)
SELECT replicate, model, {ROUNDED}, n FROM metrics"""


def auc_sql(times: int, seed: int) -> str:
    """CTE a(replicate, positives, negatives, roc_auc)."""
    return f"""{scan_sql(times, seed, model=None, pairs=LABELLED, rows="SELECT row_ix FROM p")},
c AS (SELECT replicate, score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg
  FROM s GROUP BY replicate, score),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT replicate, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
  sum(pos::DOUBLE * (below::DOUBLE + neg::DOUBLE / 2)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS roc_auc
  FROM w GROUP BY replicate)"""


def speed_ups_sql(keys: str) -> str:
    return f"""WITH {RC},
b AS (SELECT elapsed AS baseline, {keys} FROM r WHERE NOT parallel),
u AS (SELECT r.*, baseline, baseline / nullif(elapsed, 0) AS speed_up
  FROM r JOIN b USING ({keys}) WHERE parallel)"""


SPEED_UPS = speed_ups_sql("run, framework, backend, platform")

PANEL = """f AS (SELECT * FROM m WHERE framework = 'future' AND backend = 'mirai' AND parallel
  AND pid <> main_pid AND platform IN ('unix')),
x AS (SELECT * FROM f WHERE run = (SELECT min(run) FROM f))"""


MOMENTS = f"""WITH {MC},
t AS (SELECT run, framework, backend, platform, pid, epoch_us(time) AS moment, max(CASE WHEN pct_cpu > 50 THEN 1 ELSE 0 END) AS on_
  FROM m WHERE parallel AND pid <> main_pid GROUP BY run, framework, backend, platform, pid, epoch_us(time)),
c AS (SELECT run, framework, backend, platform, moment,
    CASE WHEN lead(moment) OVER w IS NULL THEN 0 ELSE on_ END - coalesce(lag(on_) OVER w, 0) AS change FROM t
  WINDOW w AS (PARTITION BY run, framework, backend, platform, pid ORDER BY moment)),
n AS (SELECT run, framework, backend, platform, moment, sum(change) AS change FROM c
  GROUP BY run, framework, backend, platform, moment HAVING sum(change) <> 0),
b AS (SELECT run, framework, backend, platform, moment, (sum(change) OVER (PARTITION BY run, framework, backend, platform ORDER BY moment))::BIGINT AS busy FROM n)"""


def oracles(times: int, seed: int) -> dict[str, str]:
    metrics = f"metrics AS (SELECT replicate, {METRICS} FROM s GROUP BY replicate)"
    by_model = f"metrics AS (SELECT replicate, model, {METRICS}, count(*) AS n FROM s GROUP BY replicate, model)"
    whole = f"""WITH {P},
metrics AS (SELECT {METRICS} FROM p WHERE model = 'six_per_word')"""
    ci = """round(quantile_cont(estimate, 0.025), 8) AS lower, round(avg(estimate), 8) AS mean,
  round(quantile_cont(estimate, 0.975), 8) AS upper, count(estimate) AS replicates"""
    drawn, models = scan_sql(times, seed), scan_sql(times, seed, model=None)
    sql = {
        "metrics_wide": f"{whole} SELECT {ROUNDED} FROM metrics",
        "metrics_long": f"""{whole}, long AS ({long_sql("metrics")})
SELECT metric, estimator, round(estimate, 6) AS estimate FROM long""",
        "metrics_by_model": f"""WITH {P},
metrics AS (SELECT model, {METRICS} FROM p GROUP BY model)
SELECT model, {ROUNDED} FROM metrics""",
        "bootstrap_draws": f"""{drawn}
SELECT row_ix, count(*) AS n, count(DISTINCT replicate) AS replicates, sum(truth) AS truth, sum(estimate) AS estimate
FROM s GROUP BY row_ix""",
        "bootstrap_draw_counts": f"""{drawn}
SELECT replicate, count(*) AS n FROM s GROUP BY replicate""",
        "replicate_completeness": f"""SELECT model, {times}::BIGINT AS replicates, {times}::BIGINT AS scored,
  count(*) AS smallest, count(*) AS largest FROM ({PAIRS_SQL}) GROUP BY model""",
        "bootstrap_first_split": f"""{scan_sql(1, seed)}, {metrics}, long AS ({long_sql("metrics")})
SELECT metric, estimator, round(estimate, 6) AS estimate FROM long""",
        "bootstrap_last_split": f"""{scan_sql(times, seed, times)}, {metrics},
long AS ({long_sql("metrics", "replicate,")})
SELECT replicate, metric, estimator, round(estimate, 6) AS estimate FROM long""",
        "bootstrap_metrics": f"""{drawn}, {metrics},
long AS ({long_sql("metrics", "replicate,")})
SELECT replicate, metric, estimator, round(estimate, 6) AS estimate FROM long""",
        "bootstrap_metrics_by_model": f"""{models}, {by_model}
SELECT replicate, model, {ROUNDED}, n FROM metrics""",
        "bootstrap_rare_model": f"""{scan_sql(times, seed, model=None, pairs=RARE_SQL)},
known AS (SELECT * FROM s WHERE estimate IS NOT NULL),
metrics AS (SELECT replicate, model, {METRICS}, count(*) AS n FROM known GROUP BY replicate, model)
SELECT r.replicate, m.model, {ROUNDED}, coalesce(n, 0) AS n
FROM range(1, {times + 1}) r(replicate) CROSS JOIN (SELECT DISTINCT model FROM p) m
LEFT JOIN metrics ON metrics.replicate = r.replicate AND metrics.model = m.model""",
        "bootstrap_ci": f"""{drawn}, {metrics},
long AS ({long_sql("metrics", "replicate,")})
SELECT metric, estimator, {ci} FROM long GROUP BY metric, estimator""",
        "bootstrap_ci_by_model": f"""{models}, {by_model},
long AS ({long_sql("metrics", "replicate, model,")})
SELECT model, metric, {ci} FROM long GROUP BY model, metric""",
        "bootstrap_ci_sketch": f"""{models}, {by_model},
long AS ({long_sql("metrics", "replicate, model,")})
SELECT model, metric, count(estimate) AS replicates, TRUE AS lower_enclosed, TRUE AS upper_enclosed, TRUE AS lower_near, TRUE AS upper_near,
  TRUE AS small_error FROM long GROUP BY model, metric HAVING count(estimate) > 0""",
        "bootstrap_scan": f"""{drawn}, {metrics}
SELECT replicate, {ROUNDED} FROM metrics""",
        "bootstrap_scan_counts": f"""SELECT b.replicate, model, count(*) AS n
FROM ({PAIRS_SQL}) CROSS JOIN range(1, {times + 1}) b(replicate) GROUP BY b.replicate, model""",
        "bootstrap_gather": f"""{sets_sql(times, seed)}, {metrics}
SELECT replicate, {ROUNDED} FROM metrics""",
        "bootstrap_poisson": poisson_sql(times, seed),
        "bootstrap_udf": f"""{drawn}
SELECT replicate, round(sqrt(sum((truth - estimate) * (truth - estimate)) / count(*)), 6) AS rmse,
  round(sum(CASE WHEN abs(truth - estimate) <= 0.1::DOUBLE * truth THEN 1 ELSE 0 END)::DOUBLE
    / count(*), 6) AS within_tenth
FROM s GROUP BY replicate""",
        "bootstrap_median_error": f"""{drawn}
SELECT replicate, quantile_cont(abs(truth - estimate), 0.5) AS median_error FROM s GROUP BY replicate""",
        "bootstrap_median_error_by_model": f"""{models}
SELECT replicate, model, quantile_cont(abs(truth - estimate), 0.5) AS median_error FROM s GROUP BY replicate, model""",
        "roc_auc": """WITH d AS (SELECT quality AS truth, n_chars AS score FROM documents JOIN labels USING (doc_id)),
ranked AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM d),
totals AS (SELECT count(*) FILTER (truth = 1) AS positives, count(*) FILTER (truth = 0) AS negatives,
  sum(r) FILTER (truth = 1) AS ranks FROM ranked)
SELECT positives, negatives, round((ranks - positives::DOUBLE * (positives + 1) / 2) / (positives::DOUBLE * negatives), 9) AS roc_auc
FROM totals""",
        "bootstrap_auc": f"""{auc_sql(times, seed)}
SELECT replicate, positives, negatives, round(roc_auc, 9) AS roc_auc FROM a""",
        "bootstrap_auc_ci": f"""{auc_sql(times, seed)}
SELECT 'roc_auc' AS metric, round(quantile_cont(roc_auc, 0.025), 9) AS lower,
  round(avg(roc_auc), 9) AS mean, round(quantile_cont(roc_auc, 0.975), 9) AS upper, count(roc_auc) AS replicates FROM a""",
        "indexed_rows": """SELECT count(*) AS n, count(*) AS distinct_rows, 0::BIGINT AS first,
  count(*) - 1 AS last, sum(l_quantity) AS quantity FROM lineitem""",
        "results_clean": f"WITH {RC} SELECT * FROM r",
        "results_tagged": """SELECT l_extendedprice AS elapsed, l_quantity AS user_self, FALSE AS parallel,
  7::BIGINT AS run, 8::INTEGER AS num_workers, 'future' AS framework, 'mirai' AS backend, 'source' AS platform
FROM lineitem""",
        "results_union": f"""WITH {RC}
SELECT run, parallel, elapsed, user_self, CASE WHEN parallel THEN NULL ELSE sys_self END AS sys_self FROM r""",
        "results_count": f"""WITH {RC}
SELECT platform, framework, backend, count(*) AS n FROM r GROUP BY platform, framework, backend""",
        "num_workers_distinct": f"WITH {RC} SELECT DISTINCT platform, framework, backend, num_workers FROM r",
        "num_workers_first": f"""WITH {MC}
SELECT num_workers FROM m ORDER BY platform, framework, backend, run, time, pid, num_workers LIMIT 1""",
        "baseline": f"""WITH {RC}
SELECT elapsed AS baseline, run, framework, backend, platform FROM r WHERE NOT parallel""",
        "speed_ups": f"""{SPEED_UPS}
SELECT run, framework, backend, platform, num_workers, elapsed, baseline, speed_up,
  round(log2(speed_up), 9) AS log2_speed_up FROM u""",
        "speed_ups_no_platform": f"""{speed_ups_sql("run, framework, backend")}
SELECT run, framework, backend, platform, elapsed, baseline, speed_up FROM u""",
        "speed_ups_with_workers": f"""{SPEED_UPS},
lines AS (SELECT DISTINCT platform, num_workers AS ideal FROM r)
SELECT run, framework, backend, platform, elapsed, baseline, speed_up, ideal FROM u JOIN lines USING (platform)""",
        "mean_speed_up": f"""{SPEED_UPS}
SELECT backend, framework, round(avg(speed_up), 6) AS mean FROM u GROUP BY backend, framework""",
        "mean_speed_up_backend": f"""{SPEED_UPS}
SELECT backend, round(avg(speed_up), 6) AS mean FROM u GROUP BY backend""",
        "best_configuration": f"""{SPEED_UPS},
means AS (SELECT backend, framework, avg(speed_up) AS mean FROM u GROUP BY backend, framework)
SELECT backend, framework, round(mean, 6) AS mean FROM means WHERE mean = (SELECT max(mean) FROM means)""",
        "best_speed_up": f"""{SPEED_UPS},
means AS (SELECT backend, framework, avg(speed_up) AS mean FROM u GROUP BY backend, framework)
SELECT round_even(max(mean), 1) AS best_speed_up FROM means""",
        "best_speed_up_no_platform": f"""{speed_ups_sql("run, framework, backend")},
means AS (SELECT backend, framework, avg(speed_up) AS mean FROM u GROUP BY backend, framework)
SELECT round_even(max(mean), 1) AS best_speed_up FROM means""",
        "files_stacked": """SELECT 'documents.parquet' AS file, doc_id FROM documents
UNION ALL SELECT 'labels.parquet' AS file, doc_id FROM labels""",
        "results_rewritten": f"""SELECT * REPLACE (CASE WHEN run % 3 = 0 THEN 2 * elapsed ELSE elapsed END AS elapsed) FROM ({BATCH_TIMES_SQL})""",
        "timing_vector": """SELECT sum(l_quantity) AS elapsed, max(l_tax) AS sys_self, 7::BIGINT AS run, TRUE AS parallel, 'future' AS framework
FROM lineitem""",
        "result_paths": f"""WITH {RC}
SELECT DISTINCT backend, platform, run, 'results/res-' || backend || '-' || platform || '-' || run AS path FROM r""",
        "results_count_ordered": f"""WITH {RC}
SELECT platform, framework, backend, count(*) AS n, row_number() OVER (ORDER BY platform, framework, backend) AS place
FROM r GROUP BY platform, framework, backend""",
        "monitor_saved": f"""WITH {MC}
SELECT run, pid, epoch_us(time) AS time_us, pct_cpu, platform, num_workers, 100 + run AS main_pid FROM m""",
        "monitor_main_pid_by_file": f"""WITH {MC}
SELECT 'monitor-all-all-' || run AS file, run, pid, epoch_us(time) AS time_us, pct_cpu, CASE WHEN run <> 3 THEN 200 + run END AS main_pid FROM m""",
        "duplicate_run_keys": f"""WITH {RC}
SELECT run, framework, backend, platform, count(*) AS n FROM r WHERE NOT parallel
GROUP BY run, framework, backend, platform HAVING count(*) > 1""",
        "monitor_clean": f"""WITH {MC}
SELECT run, pid, epoch_us(time) AS time_us, pct_cpu, parallel, framework, backend, platform, num_workers, main_pid
FROM m""",
        "monitor_main_pid": f"""WITH {MC}
SELECT run, pid, epoch_us(time) AS time_us, pct_cpu, 100 + n_regionkey AS main_pid
FROM m LEFT JOIN nation ON n_nationkey = run AND n_nationkey BETWEEN 1 AND 4""",
        "monitor_count": f"""WITH {MC}
SELECT platform, framework, backend, count(*) AS n FROM m GROUP BY platform, framework, backend""",
        "monitor_rel_time": f"""WITH {M},
s AS (SELECT *, epoch_us(time) / 1e6::DOUBLE AS sec FROM raw_m),
l AS (SELECT *, min(sec) OVER w AS low, max(sec) OVER w AS high FROM s
  WINDOW w AS (PARTITION BY run, framework, backend, platform))
SELECT run, pid, framework, backend, platform, sec AS epoch_seconds, pct_cpu,
  round((sec - low) / nullif(high - low, 0), 9) AS rel_time FROM l""",
        "cpu_range": f"""WITH {MC}
SELECT run, pid, framework, backend, max(pct_cpu) AS max_cpu, min(pct_cpu) AS min_cpu
FROM m GROUP BY run, pid, framework, backend""",
        "cpu_outliers": f"""WITH {MC}
SELECT run, pid, framework, backend FROM m GROUP BY run, pid, framework, backend
HAVING max(pct_cpu) > 250 OR min(pct_cpu) IS NOT NULL AND max(pct_cpu) < 1""",
        "worker_panel": f"""WITH {MC}, {PANEL},
c AS (SELECT pid, row_number() OVER (ORDER BY pid) AS code FROM (SELECT DISTINCT pid FROM x)),
k AS (SELECT max(length(code::VARCHAR)) AS width FROM c)
SELECT run, x.pid, code, epoch_us(time) AS time_us, strftime(time, '%M:%S') AS min_sec, pct_cpu,
  'worker process ' || lpad(code::VARCHAR, width::INT, ' ') AS worker
FROM x JOIN c ON x.pid = c.pid CROSS JOIN k""",
        "panel_labels": f"""WITH {MC},
f AS (SELECT * FROM m WHERE parallel AND pid <> main_pid),
g AS (SELECT framework, backend, platform, run, (epoch_us(max(time)) - epoch_us(min(time))) / 1e6::DOUBLE AS seconds,
    rank() OVER (PARTITION BY framework, backend, platform ORDER BY run) AS k
  FROM f GROUP BY framework, backend, platform, run)
SELECT framework, backend, platform, run, ceil(seconds)::BIGINT AS total_seconds,
  framework || ' via ' || backend || ' (' || platform || ')' AS title,
  'Time (min:sec)' || chr(10) || 'total time: ' || ceil(seconds)::BIGINT::VARCHAR || 's' AS x_label
FROM g WHERE k = 1""",
        "labels_of_panel": f"""WITH {MC},
f AS (SELECT * FROM m WHERE framework = 'future' AND backend = 'mirai' AND parallel AND pid <> main_pid
  AND platform IN ('unix', 'macOS')),
g AS (SELECT run, (epoch_us(max(time)) - epoch_us(min(time))) / 1e6::DOUBLE AS seconds
  FROM f WHERE run = (SELECT min(run) FROM f) GROUP BY run)
SELECT 'future' AS framework, 'mirai' AS backend, platform, run, ceil(seconds)::BIGINT AS total_seconds,
  'future via mirai (' || platform || ')' AS title,
  'Time (min:sec)' || chr(10) || 'total time: ' || ceil(seconds)::BIGINT::VARCHAR || 's' AS x_label
FROM g CROSS JOIN (SELECT unnest(['unix', 'macOS']) AS platform)""",
        "single_run": f"""WITH {MC}
SELECT run, pid, epoch_us(time) AS time_us, pct_cpu, backend, platform FROM m
WHERE framework = 'foreach/doFuture/%dopar%' AND parallel AND pid <> main_pid AND run = 3""",
        "busy_workers": f"""WITH {MC}
SELECT epoch_us(date_trunc('hour', time)) AS start_us,
  count(DISTINCT CASE WHEN pct_cpu > 50 THEN concat_ws('|', run, framework, backend, platform, pid) END) AS busy,
  count(*) AS samples
FROM m WHERE parallel AND pid <> main_pid GROUP BY date_trunc('hour', time)""",
        "idle_share": f"""WITH {MC}
SELECT run, framework, backend, platform, pid, count(*) AS samples,
  round(avg(CASE WHEN pct_cpu < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS idle_share
FROM m WHERE parallel AND pid <> main_pid GROUP BY run, framework, backend, platform, pid""",
        "busy_at_moments": f"{MOMENTS} SELECT * FROM b",
        "busy_peak": f"""{MOMENTS},
l AS (SELECT *, coalesce(lead(moment) OVER (PARTITION BY run, framework, backend, platform ORDER BY moment) - moment, 0) AS length FROM b)
SELECT run, framework, backend, platform, max(busy) AS peak, arg_min(moment, {{'b': -busy, 'a': moment}}) AS moment,
  round(sum(busy * length)::DOUBLE / nullif(sum(length), 0)::DOUBLE, 9) AS mean_busy FROM l GROUP BY run, framework, backend, platform""",
        "idle_periods": f"""WITH {MC},
t AS (SELECT run, framework, backend, platform, pid, epoch_us(time) AS moment, max(CASE WHEN pct_cpu >= 30 THEN 1 ELSE 0 END) AS busy, count(*) AS samples
  FROM m WHERE parallel AND pid <> main_pid GROUP BY run, framework, backend, platform, pid, epoch_us(time)),
i AS (SELECT *, row_number() OVER (PARTITION BY run, framework, backend, platform, pid ORDER BY moment)
  - row_number() OVER (PARTITION BY run, framework, backend, platform, pid, busy ORDER BY moment) AS island FROM t)
SELECT run, framework, backend, platform, pid, min(moment) AS start_at, max(moment) AS end_at, sum(samples)::BIGINT AS samples
FROM i WHERE busy = 0 GROUP BY run, framework, backend, platform, pid, island""",
        "package_names": "SELECT p_partkey, replace(p_name, 'small ', '') AS name FROM part",
    }
    for name, groups in (
        ("elapsed_trend", "backend, platform, framework"),
        ("elapsed_trend_no_platform", "backend, framework"),
    ):
        x = "CASE WHEN parallel THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
        sql[name] = f"""WITH {RC}
SELECT {groups}, count(*) AS n, round(regr_slope(elapsed, {x}), 4) AS slope,
  round(regr_intercept(elapsed, {x}), 4) AS intercept FROM r GROUP BY {groups}"""
    for name in ("results_count", "mean_speed_up", "elapsed_trend", "cpu_range", "cpu_outliers"):
        sql[f"{name}_merged"] = sql[name]
    return sql
