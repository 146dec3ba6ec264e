"""Vector columns as fixed-width rows of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All usable rows of a list column as doubles, zeros after shorter ones, and which rows they are.

    Unusable: null or zero vectors, and those with a null, infinite or not-a-number component.
    """
    rows = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((rows, width))
    owner = np.repeat(np.arange(rows), lengths)
    starts = np.cumsum(lengths) - lengths
    out[owner, np.arange(len(values)) - np.repeat(starts, lengths)] = values
    good = np.flatnonzero(np.isfinite(out).all(axis=1) & (out != 0).any(axis=1))
    return out[good], good


def stored(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """Written table `row, id, vec` (doubles as bytes) of the usable vectors; `row` numbers them uniquely."""
    width = df.agg(F.max(F.size(vector_col)).alias("w")).first()["w"] or 0
    width = max(width, 1)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found, good = dense(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good)), pa.array([v.tobytes() for v in found], pa.binary())], names=["id", "vec"])

    typed = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return materialize(typed.mapInArrow(run, f"id {kind}, vec binary").withColumn("row", F.monotonically_increasing_id()), name)


def matrix(column) -> np.ndarray:
    """Stored vectors of a chunked or plain binary column, one per row."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled down first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1.0)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def mean(table: DataFrame) -> np.ndarray:
    """Mean of all stored vectors; one sum leaves each task. A single zero for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0)).sum(axis=0)
                total, rows = own if total is None else total + own, rows + batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([rows], pa.int64())], names=["total", "rows"])

    sums = table.select("vec").mapInArrow(run, "total array<double>, rows long").select("rows", F.posexplode("total").alias("at", "x"))
    got = sums.groupBy("at").agg((F.sum("x") / F.sum("rows")).alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in got]) if got else np.zeros(1)


def spread_sample(table: DataFrame, wanted: int, pool: int, least_apart: float, centre: np.ndarray | float = 0.0) -> np.ndarray:
    """Up to `wanted` directions from `centre` of at most `pool` rows (smallest hashes), none with cosine above `least_apart` to one taken before."""
    got = table.select("vec", F.xxhash64("vec").alias("h")).distinct().orderBy("h").limit(pool).collect()
    if not got:
        return np.zeros((0, 1))
    x = directions(np.frombuffer(b"".join(r["vec"] for r in got)).reshape(len(got), -1) - centre)
    x = x[(x != 0).any(axis=1)]
    taken = np.zeros((0, x.shape[1]))
    for at in range(0, len(x), 512):
        block = x[at : at + 512]
        block = block[(block @ taken.T <= least_apart).all(axis=1)] if len(taken) else block
        near = block @ block.T
        keep: list[int] = []
        for i in range(len(block)):
            if not keep or near[i, keep].max() <= least_apart:
                keep.append(i)
        taken = np.concatenate([taken, block[keep]])
        if len(taken) >= wanted:
            break
    return taken[:wanted]
