"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each text gives a few statistics (shares of character classes, word lengths, repetition). Standardised, they go through
FEATURES random cosines, which approximate a Gaussian kernel; partitions sum the normal equations of ridge regression
over a bounded sample of labelled rows (`fit.SAMPLE_ROWS`), and pooled neighbours calibrate the scores of the part of
the sample that the ridge hasn't seen. Scoring is a narrow map over whole texts.

Defined results: null and empty texts have zero statistics and are scored like any text; without usable labels every
score is 0.5; repeated rows get the same score; equal raw scores share one calibrated rate; very long texts are scored
whole; a null id is held out; an empty table gives an empty result. Other columns than id and text are not carried, so
clashing names can't arise (`keep` passes all columns through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import held_out, read
from weftline.llm.fit import SAMPLE_ROWS, Isotonic, labelled_sample
from weftline.llm.words import Words, pieces

FEATURES = 320
WIDTH = 4.0
RIDGE = 1e-3
PARTS = 12
THRESHOLD = 0.7

_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _HIGH, _LINE = range(7)
_CLASS = np.zeros((7, 256), np.bool_)
_CLASS[_LETTER, [*range(65, 91), *range(97, 123)]] = True
_CLASS[_UPPER, 65:91] = True
_CLASS[_DIGIT, 48:58] = True
_CLASS[_STOP, [33, 39, 44, 45, 46, 58, 59, 63]] = True
_CLASS[_SYMBOL, [i for i in range(33, 127) if not _CLASS[:4, i].any()]] = True
_CLASS[_HIGH, 128:] = True
_CLASS[_LINE, [10, 13]] = True
#: Byte classes as bits, so that one table look-up per byte serves all.
_BITS = (_CLASS * (1 << np.arange(7))[:, None]).sum(axis=0).astype(np.uint8)
N_STATS = 19


def statistics(column: pa.Array) -> np.ndarray:
    """N_STATS numbers for each text."""
    words = Words(column)
    rows = len(column)
    size = np.diff(words.offsets)
    n = np.diff(words.first)
    bits = _BITS[words.raw]
    per_byte = np.maximum(size, 1)
    out = np.zeros((rows, N_STATS))
    row_of_byte = np.repeat(np.arange(rows), size)
    for k in range(7):
        out[:, k] = np.bincount(row_of_byte[(bits >> k & 1).view(np.bool_)], minlength=rows) / per_byte
    row = np.repeat(np.arange(rows), n)
    per_word = np.maximum(n, 1)
    length = (words.stop - words.start).astype(float)
    out[:, 7] = np.bincount(row, length, rows) / per_word
    out[:, 8] = np.sqrt(np.maximum(np.bincount(row, length * length, rows) / per_word - out[:, 7] ** 2, 0))
    h = words.hash
    last = bits[words.stop - 1] if len(h) else bits[:0]
    lead = bits[words.start] if len(h) else bits[:0]
    out[:, 9] = np.bincount(row, (last >> _SYMBOL) & 1, rows) / per_word
    out[:, 10] = np.bincount(row, (length == 1) & ((lead >> _SYMBOL) & 1).view(np.bool_), rows) / per_word
    out[:, 11] = np.bincount(row, (last >> _STOP) & 1, rows) / per_word
    for k, gap in enumerate((1, 2)):
        same = np.zeros(len(h))
        same[gap:] = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
        out[:, 12 + k] = np.bincount(row, same, rows) / per_word
    top, kinds = np.zeros(rows), np.zeros(rows)
    for i in np.flatnonzero(n).tolist():
        s = np.sort(h[words.first[i] : words.first[i + 1]])
        edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        kinds[i], top[i] = len(edges) - 1, np.diff(edges).max()
    out[:, 14] = kinds / per_word
    out[:, 15] = top / per_word
    out[:, 16] = np.log1p(n)
    out[:, 17] = np.log1p(kinds) - np.log1p(n) * 0.8
    out[:, 18] = np.log1p(np.bincount(row, length > 24, rows))
    return out


class Model:
    """Frequencies, ridge weights and calibration; a few hundred kilobytes whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.frequency = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weight = np.zeros(FEATURES + 1)
        self.calibrate = Isotonic(np.zeros(0), np.zeros(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrate(self.raw(stats))


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            stats = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, N_STATS)
            z = model.features(stats)
            gram += z.T @ z
            right += z.T @ batch.column(1).to_numpy()
            n += len(stats)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()]), pa.array([n], pa.int64())], names=["gram", "right", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model of P(label = 1). Three small jobs over `rows` labelled rows at most, in PARTS tasks that return one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            stats = statistics(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in stats]), part.column(1), part.column(2)], names=["stats", "label", "order"])

    sample = labelled_sample(docs, labels, label, rows, id_col, text_col).repartition(PARTS, "order")
    known = sample.select("text", "label", "order").mapInArrow(run, "stats binary, label int, order long").persist()
    got = known.select("stats").collect()
    if not got:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    stats = np.frombuffer(b"".join(r["stats"] for r in got)).reshape(-1, N_STATS)
    model = Model(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    seen = known.filter(F.pmod("order", F.lit(4)) != 0)
    gram, right, n = np.eye(FEATURES + 1) * 1e-9, np.zeros(FEATURES + 1), 0
    for r in seen.select("stats", "label").mapInArrow(_sums(model), "gram binary, right binary, n long").collect():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        right += np.frombuffer(r["right"])
        n += r["n"]
    model.weight = np.linalg.solve(gram + RIDGE * max(n, 1) / FEATURES * np.eye(FEATURES + 1), right)
    rest = known.filter(F.pmod("order", F.lit(4)) == 0).select("stats", "label").collect() or known.select("stats", "label").collect()
    known.unpersist()
    stats = np.frombuffer(b"".join(r["stats"] for r in rest)).reshape(-1, N_STATS)
    model.calibrate = Isotonic(model.raw(stats), np.array([r["label"] for r in rest]))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and `score`."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], names=["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose text scores `threshold` or more: a filter without any shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            yield part.filter(pa.array(model.score(statistics(part.column(at))) >= threshold))

    return df.mapInArrow(run, df.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
