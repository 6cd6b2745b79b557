"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, as Parquet, and returns the columns of documents; the last
returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resamplia.llm import decontamination, linedup, neardup, packing, toxicity
from resamplia.llm.queries import TOKENIZER
from resamplia.llm.shared import new_folder, remove, stored, sweep, table, tidy

# The general rule for near-duplicates: shingles of five words, similarity 0.8.
SHINGLE, PERCENT = 5, 80
REJECT = 0.5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score REJECT or more go. The model learns from the labelled ones among `docs`."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < REJECT).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike one stays. All documents stay, some with less text; n_chars follows the text."""
    out = linedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest doc_id (null last), then the smallest md5 of the text,
    then the smallest other columns. Texts without words all stay."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["_doc"]) & (text == keys["_md5"])
    found = neardup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT, by_text=True).filter("n_shingles > 0")
    keys = found.groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_md5")).agg(F.first("kept").alias("_kept"), F.count("*").alias("_n"))
    keys = stored(keys.filter("not _kept or _n > 1"))
    out = docs.join(keys, same(keys), "left_anti")
    again = keys.filter("_kept")
    if again.limit(1).count():
        row = F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_row")
        rows = docs.join(again, same(again), "left_semi").groupBy("doc_id", text.alias("_md5")).agg(row)
        out = out.unionByName(rows.select("_row.*"))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words in passages of benchmark items go."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_md5")).distinct()
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (text == gone["_md5"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.pack(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[str] = []


def tidied(stage: Stage) -> Stage:
    """The stage, which first removes the tables that the stage before has written on its way, and what it stored: its result is a
    table of its own by now. They stay if `docs` still reads them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _tables else []
        names = [folder.rstrip("/").rsplit("/", 1)[-1] for folder in _tables]
        if not any(f"/{name}/" in file for name in names for file in read):
            remove(spark, _tables)
        sweep(spark)
        with tidy(spark) as made:
            out = stage(spark, docs, sf_dir)
        _tables[:] = made
        return out

    return run


STAGES = [
    ("toxicity", tidied(remove_toxic)),
    ("line_dedup", tidied(dedup_lines)),
    ("near_dedup", tidied(dedup_documents)),
    ("decontamination", tidied(decontaminate)),
    ("packing", tidied(pack)),
]

# SQL cannot express compression distances, signatures or tokenizers; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each keeps is written to the shared folder and read again, and goes when the next has
    been written."""
    folder = new_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    remove(spark, _tables)
    _tables.clear()
    return docs
