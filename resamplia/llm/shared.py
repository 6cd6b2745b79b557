"""What the operators share: tables, the shared folder, byte-bounded batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are handled in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 21
# Texts that become words, hashes or tokens take many times their bytes meanwhile, so their pieces are shorter.
HASHED_BYTES = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one is used only
    where that is unset and driver and executors are one local process, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="resamplia-shared-")
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the shared folder, so that they are computed once and a lost
    executor cannot change them."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_made: list[list[str]] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[str]]:
    """Within, shuffle files go as soon as the query that wrote them has ended, instead of when the driver collects its garbage, and Python
    gets fewer bytes at a time; gives the folders of the tables that `written` makes within."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(PIECE_BYTES)}
    before, folders = {key: spark.conf.get(key, None) for key in own}, []
    for key, value in own.items():
        spark.conf.set(key, value)
    _made.append(folders)
    try:
        yield folders
    finally:
        _made.pop()
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver look for steps that nothing refers to any more. Where spark.cleaner.referenceTracking.cleanCheckpoints is set, what
    `stored` wrote for them goes; else nothing changes."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """As `stored`, as a compressed table; for texts."""
    folder = new_folder(df.sparkSession, name)
    for folders in _made:
        folders.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# Counted rows up to which the side with one row per key is broadcast, and parts of a hot key beyond that.
FEW_KEYS, SALTS = 200_000, 32


def beside(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join `left` with `right`, which has one row per `key`. Few keys are broadcast; else the rows of a key are dealt to SALTS
    parts by a hash of the columns `spread`, each with its copy of the key's row, so that no key is one task."""
    right = stored(right)
    if right.count() <= FEW_KEYS:
        return left.join(F.broadcast(right), key, how)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins (one more at the end).
    Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(lengths) // limit)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


#: How to empty what modules remember in a Python worker. Workers are used again by other operators.
memories: list[Callable[[], None]] = []


def forget() -> None:
    """Called at the beginning of tasks that need much memory themselves."""
    for empty in memories:
        empty()
    release()


def release() -> None:
    """Gives what is free to the system: a worker goes on to other tasks, and its executor has a limit for all of them."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # what numpy and Python have from malloc


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function for mapInArrow, whose memory goes back to the system when a task ends."""

    @wraps(run)
    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def by_pieces(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A function for mapInArrow that applies `work` to bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            out = work(piece)
            if out is not None:
                yield out

    return run


def flatten(lists: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and int32 offsets, as an Arrow list column needs them."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.empty(0)
    return values.astype(dtype, copy=False), offsets
