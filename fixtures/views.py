"""Views over the given tables: pairs, results and monitor (see FIXTURES.md).

Each exists as a DataFrame and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resamplia.operators.ordered import dense_codes

MODELS = ("six_per_word", "five_plus", "constant")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    # Blanks + 1 is the number of parts between blanks; nothing is split. A blank is one byte.
    blanks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit("")))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_ix"),
        F.col("n_chars").cast("double").alias("truth"),
        (blanks + 1).cast("double").alias("words"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Text length in characters, and three simple predictions of it from the word count."""
    models = F.array(*[F.lit(model) for model in MODELS])
    estimate = (
        F.when(F.col("model") == "six_per_word", 6 * F.col("words"))
        .when(F.col("model") == "five_plus", 5 * F.col("words") + 40)
        .otherwise(400.0)
    )
    rows = word_pairs(spark, folder).withColumn("model", F.explode(models))
    return rows.select("row_ix", "model", "truth", estimate.alias("estimate"))


def model_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The first model alone."""
    return word_pairs(spark, folder).select(
        "row_ix", "truth", (6 * F.col("words")).alias("estimate")
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of one order are the timings of one run: even lines parallel, odd ones sequential."""
    line = table(spark, folder, "lineitem")
    order = table(spark, folder, "orders")
    even = F.col("o_orderkey") % 2 == 0
    low = F.col("o_orderkey") % 4 < 2
    status = F.col("o_orderstatus")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr("(o_orderkey - o_orderkey % 2) div 2").alias("run"),
        F.when(status == "F", "foreach/doFuture/%dopar%")
        .when(status == "O", "foreach")
        .otherwise("future")
        .alias("framework"),
        F.when(status == "F", "multisession")
        .when((status == "O") & low, "foreach")
        .when((status == "P") & low, "multisession")
        .otherwise("mirai")
        .alias("backend"),
        F.when(even, "source").otherwise("mac.binary.big-sur-arm64").alias("platform"),
        F.when(even, 8).otherwise(12).alias("num_workers"),
        (F.col("l_linenumber") % 2 == 0).alias("parallel"),
        F.col("l_extendedprice").alias("elapsed"),
        F.col("l_quantity").alias("user_self"),
        F.col("l_tax").alias("sys_self"),
    )


def monitor(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        (1 + event % 5).alias("run"),
        F.col("user_id").alias("pid"),
        F.col("ts").cast("timestamp").alias("time"),
        F.when(event % 50 != 0, F.col("value")).alias("pct_cpu"),
        (event % 7 != 3).alias("parallel"),
        F.when(kind.isin("click", "error"), "future")
        .when(kind == "view", "foreach/doFuture/%dopar%")
        .otherwise("foreach")
        .alias("framework"),
        F.when(kind.isin("click", "purchase"), "mirai").otherwise("multisession").alias("backend"),
        F.when(event % 2 == 0, "source").otherwise("mac.binary.big-sur-arm64").alias("platform"),
        F.when(event % 3 == 0, 4).when(event % 2 == 0, 8).otherwise(12).alias("num_workers"),
        (1 + event % 5).alias("main_pid"),
    )


def batch_times(spark: SparkSession, folder: str) -> DataFrame:
    """Timings of 20 batches: the orders of a batch are added up, for each scenario and kind."""
    rows = results(spark, folder).withColumn("run", F.col("run") % 20)
    keys = ["run", "framework", "backend", "platform", "num_workers", "parallel"]
    return rows.groupBy(*keys).agg(F.sum("user_self").alias("user_self"), F.sum("user_self").alias("elapsed"), F.count("*").alias("lines"))


def quality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with text length as score, numbered in the order of doc_id."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("estimate"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("truth"))
    rows = docs.join(labels, "doc_id").where("truth in (0, 1)")
    numbers = dense_codes(rows, "doc_id").select("doc_id", (F.col("code") - 1).alias("row_ix"))
    return rows.join(numbers, "doc_id").select("row_ix", "truth", "estimate")


def rare_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Two models, of which `rare` has a prediction for one document in 300 only."""
    rows = model_pairs(spark, folder)
    rare = F.when(F.col("row_ix") % 300 == 0, F.col("estimate"))
    return rows.withColumn("model", F.lit("six_per_word")).unionByName(
        rows.withColumns({"estimate": rare, "model": F.lit("rare")})
    )


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """0/1 outcome and numeric score of labelled documents."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("score"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("truth"))
    return docs.join(labels, "doc_id").select("truth", "score")


PAIRS_SQL = """
SELECT doc_id AS row_ix, m.model AS model, CAST(n_chars AS DOUBLE) AS truth,
  CAST(CASE m.model WHEN 'six_per_word' THEN 6 * words
                    WHEN 'five_plus' THEN 5 * words + 40 ELSE 400 END AS DOUBLE) AS estimate
FROM (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS words FROM documents) d
CROSS JOIN (SELECT 'six_per_word' AS model UNION ALL SELECT 'five_plus' UNION ALL SELECT 'constant') m
"""

RESULTS_SQL = """
SELECT CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS run,
  CASE o_orderstatus WHEN 'F' THEN 'foreach/doFuture/%dopar%' WHEN 'O' THEN 'foreach' ELSE 'future' END AS framework,
  CASE WHEN o_orderstatus = 'F' THEN 'multisession'
       WHEN o_orderstatus = 'O' AND o_orderkey % 4 < 2 THEN 'foreach'
       WHEN o_orderstatus = 'P' AND o_orderkey % 4 < 2 THEN 'multisession' ELSE 'mirai' END AS backend,
  CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'mac.binary.big-sur-arm64' END AS platform,
  CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 12 END AS num_workers,
  l_linenumber % 2 = 0 AS parallel, l_extendedprice AS elapsed, l_quantity AS user_self, l_tax AS sys_self
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

MONITOR_SQL = """
SELECT 1 + event_id % 5 AS run, user_id AS pid, CAST(ts AS TIMESTAMP) AS time,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS pct_cpu, event_id % 7 <> 3 AS parallel,
  CASE event_type WHEN 'click' THEN 'future' WHEN 'error' THEN 'future'
                  WHEN 'view' THEN 'foreach/doFuture/%dopar%' ELSE 'foreach' END AS framework,
  CASE event_type WHEN 'click' THEN 'mirai' WHEN 'purchase' THEN 'mirai' ELSE 'multisession' END AS backend,
  CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'mac.binary.big-sur-arm64' END AS platform,
  CASE WHEN event_id % 3 = 0 THEN 4 WHEN event_id % 2 = 0 THEN 8 ELSE 12 END AS num_workers, 1 + event_id % 5 AS main_pid
FROM events
"""

BATCH_TIMES_SQL = f"""
SELECT run % 20 AS run, framework, backend, platform, num_workers, parallel, sum(user_self) AS user_self, sum(user_self) AS elapsed,
  count(*) AS lines FROM ({RESULTS_SQL}) GROUP BY run % 20, framework, backend, platform, num_workers, parallel
"""
