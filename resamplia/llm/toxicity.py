"""Toxic texts by compression distance.

A text is cut into windows of words. A word is written as two 8-byte codes, the hash of the word
and the hash of its beginning, so that a compressor gains only where a dictionary holds the
code. Two zstandard dictionaries are trained: one holds the codes most frequent in ordinary text, the other
also those that are typical of toxic text. The distance of a window is the number of
bytes that the toxic dictionary saves over the ordinary one. The windows' distances, against calibrated
thresholds, give a document's features, and a logistic curve its score.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.llm.shared import HASHED_BYTES, forget, pieces, released, texts
from resamplia.llm.words import LETTER_OR_DIGIT, find, mix

WINDOW = 24
BEGINNING = 4
ORDINARY_CODES, TOXIC_CODES = 4096, 2048
# Labelled documents that training looks at, at most, chosen by the hash of their text.
SAMPLE = 40_000
# A code is typical of toxic text if it is in so large a part of the toxic documents, and so many
# times as often there as in the others.
LEAST_SHARE, LEAST_RATIO = 0.01, 25.0
# A strategy that looks for a match at every position: the quick ones skip where little matches.
_EMPTY = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_GREEDY, min_match=7, window_log=18, hash_log=16, chain_log=16, search_log=4,
    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
)

_FILLER = mix(np.arange(4096, dtype=np.uint64)).tobytes()


@dataclass(frozen=True)
class Model:
    """Dictionaries as lists of codes, thresholds of a window's distance in bytes, and the curve."""

    ordinary: list[int]
    toxic: list[int]
    thresholds: list[int]
    weights: list[float]
    bias: float
    base_rate: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        return Model(**json.loads(text))


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two codes per word of each text, and the first word of each text."""
    w = find(data, offsets, LETTER_OR_DIGIT)
    ends = np.minimum(w.end, w.start + BEGINNING)
    # Hash of the first bytes, so that coined words with a common beginning share a code.
    start = np.full(len(w.start), 0x51ED, np.uint64)
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    for k in range(BEGINNING):
        at = np.minimum(w.start + k, max(0, len(data) - 1))
        byte = np.where(w.start + k < ends, lower[data[at]] if len(data) else 0, np.uint64(256))
        start = mix(start * np.uint64(0x100000001B3) + byte.astype(np.uint64) + np.uint64(1))
    out = np.empty(2 * len(w.hash), np.uint64)
    out[0::2], out[1::2] = w.hash, start
    return out, w.first


class Distance:
    """Bytes that the toxic dictionary saves per window."""

    def __init__(self, model: Model):
        ordinary = np.array(model.ordinary[::-1], np.int64).tobytes()
        toxic = np.array(model.toxic[::-1], np.int64).tobytes()
        self.packers = [zstandard.ZstdCompressor(dict_data=self._dictionary(x), compression_params=_EMPTY) for x in (ordinary, toxic + ordinary)]

    @staticmethod
    def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
        # Fixed random bytes first: zstandard does not search very small dictionaries.
        made = zstandard.ZstdCompressionDict(_FILLER + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=_EMPTY)
        return made

    def windows(self, words: bytes) -> list[int]:
        # Each window begins with bytes that both dictionaries hold, so that none is stored uncompressed.
        step = 16 * WINDOW
        a, b = (x.compress for x in self.packers)
        return [len(a(part)) - len(b(part)) for part in (_FILLER[:64] + words[k : k + step] for k in range(0, len(words), step))]


def features(distances: list[int], thresholds: list[int]) -> list[float]:
    """Logarithms of one more than the number of windows beyond each threshold, and of the largest distance."""
    d = np.array(distances or [0])
    return [*(float(np.log1p((d >= t).sum())) for t in thresholds), float(np.log1p(max(0, d.max())))]


def _labelled(fit_on: Column, docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Distinct labelled texts for training; about `sample` of them at most."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(fit_on)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    # The sample bounds what is broadcast, so texts without a chosen label are not shuffled.
    rows = docs.filter("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("half", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)))


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task: number of toxic and other texts that hold a code (code 0: all texts)."""
    sums: dict[int, list[int]] = {}
    forget()

    def out():
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64())], ["code", "toxic", "ordinary"])

    for batch in pieces(batches, "text", HASHED_BYTES):
        found, first = codes(*texts(batch.column("text")))
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            for code in {0, *found[2 * first[i] : 2 * first[i + 1]].view(np.int64).tolist()}:
                sums.setdefault(code, [0, 0])[toxic] += 1
        if len(sums) > 150_000:
            yield out()
            sums.clear()
    yield out()


def _dictionaries(rows: DataFrame) -> tuple[list[int], list[int]]:
    counts = rows.select("text", "toxic").mapInArrow(released(_code_rows), "code long, toxic long, ordinary long").groupBy("code").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))
    counts = counts.filter("t + o >= 3").cache()
    try:
        total = counts.filter("code = 0").first()
        n_toxic, n_ordinary = (total["t"], total["o"]) if total else (0, 0)
        codes_only = counts.filter("code != 0")
        ordinary = codes_only.orderBy(F.desc("o"), "code").limit(ORDINARY_CODES).collect()
        share, other = F.col("t") / max(1, n_toxic), (F.col("o") + 0.5) / (n_ordinary + 1)
        typical = codes_only.filter((share >= LEAST_SHARE) & (F.col("t") >= 5) & (share >= LEAST_RATIO * other))
        toxic = typical.orderBy(F.desc(share * F.log(share / other)), "code").limit(TOXIC_CODES).collect()
    finally:
        counts.unpersist()
    typical_codes = {r["code"] for r in toxic}
    return [r["code"] for r in ordinary if r["code"] not in typical_codes], [r["code"] for r in toxic]


def _distances(model_json: str):
    """Distances of all windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(Model.from_json(model_json))
        for batch in pieces(batches, "text", HASHED_BYTES):
            found, first = codes(*texts(batch.column("text")))
            raw = found.tobytes()
            rows = [distance.windows(raw[16 * first[i] : 16 * first[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "distances"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[list[float], float]:
    """Logistic regression by Newton's method."""
    one = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(one.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        gradient = one.T @ (p - y) / len(y) + ridge / len(y) * w
        curve = (one * (p * (1 - p))[:, None]).T @ one / len(y) + (ridge / len(y) + 1e-9) * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, fit_on: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows of `docs` (doc_id, text) for which `fit_on`, a condition on doc_id, holds.

    `labels` has doc_id and toxic (0, 1; others count as no label; of several labels of a document the larger holds).
    Thresholds and curve are fitted on one half of the texts with dictionaries made from the other, so that
    codes of rare texts get no weight that they have not earned; the dictionaries of the model are made from all. Without toxic or ordinary
    rows the model gives every text the same score.
    """
    rows = _labelled(F.lit(True) if fit_on is None else fit_on, docs, labels, sample).cache()
    try:
        bare = Model(*_dictionaries(rows.filter("half = 0")), [], [], 0.0, 0.5)
        ordinary, toxic = _dictionaries(rows)
        half = rows.filter("half = 1").select("text", "toxic")
        seen = half.mapInArrow(released(_distances(bare.to_json())), "toxic int, distances array<int>").collect()
    finally:
        rows.unpersist()
    y = np.array([r["toxic"] for r in seen], float)
    base = (float(y.sum()) + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(ordinary, toxic, [], [0.0], float(np.log(base / (1 - base))), base)
    # Thresholds: the largest distances that ordinary windows reach at these shares.
    calm = np.concatenate([np.array(r["distances"] or [0]) for r in seen if not r["toxic"]])
    thresholds = sorted({max(1, int(np.quantile(calm, q)) + 1) for q in (0.99, 0.999, 0.9999)} | {int(calm.max()) + 1})
    x = np.array([features(r["distances"], thresholds) for r in seen])
    weights, bias = _fit(x, y)
    return Model(ordinary, toxic, thresholds, weights, bias, base)


def _scorer(model_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.from_json(model_json)
        distance = Distance(model)
        weights = np.array(model.weights)
        for batch in pieces(batches, "text", HASHED_BYTES):
            found, first = codes(*texts(batch.column("text")))
            raw = found.tobytes()
            scores = []
            for i in range(batch.num_rows):
                x = features(distance.windows(raw[16 * first[i] : 16 * first[i + 1]]), model.thresholds)
                z = float(np.dot(weights, x)) + model.bias
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "toxicity"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `toxicity` from 0 to 1 (in place of one it may have).

    Null, empty and wordless texts have no window and get the score of a text without any
    typical code. All other columns are kept; repeated rows get equal scores.
    """
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return docs.mapInArrow(released(_scorer(model.to_json())), schema)
