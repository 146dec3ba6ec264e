"""Shared plumbing of the corpus operators: Arrow batch mapping, fold assignment and cut points of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker; bounds the memory of a task whatever Arrow's own batch size is.
SLICE_ROWS = 256


#: Rows of an Arrow batch between JVM and Python; texts are long, so the default of 10,000 would take much memory at once.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the plans made after this; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; a null id has no fold (null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(buckets)


def held_out(id_col: str, buckets: int, remainder: int) -> Column:
    """True for rows that nothing may be learned from; rows with a null id are held out."""
    return F.coalesce(fold(id_col, buckets) == remainder, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only for local sessions that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by a table written in the shared folder; it outlives any executor and goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote and nothing reads any more; a collection in the driver frees shuffle files of finished jobs."""
    for df in tables:
        _remove(df.sparkSession, df._weftline_path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def strings(column: pa.Array) -> list[str]:
    """Texts of a string column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' offsets in them (one more than rows); null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def int_lists(flat: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def sample_texts(df: DataFrame, by: str, text_col: str, counts: dict, rows: int, room: int) -> dict[object, list[str]]:
    """Up to `rows` distinct texts of each value of `by`, those with the smallest hashes, in that order; of a text at most its first `room` characters.

    `counts` has each value's rows: a hash threshold leaves some of each value's texts, equal ones are one by then, and
    only the `rows` smallest of each value go on, so what reaches the driver is bounded whatever the size of `df` and
    however often a text or an id is repeated. Where few distinct texts are below the threshold, all are looked at.
    """
    if not counts:
        return {}
    hashed = df.select(F.col(by).alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    share = F.pmod("h", F.lit(1 << 31)) / F.lit(float(1 << 31))
    bounds = F.create_map(*(F.lit(x) for value, n in counts.items() for x in (value, min(1.0, 4.0 * rows / max(n, 1)))))
    out: dict[object, list[str]] = {}

    def take(table: DataFrame) -> None:
        place = F.row_number().over(Window.partitionBy("k").orderBy("h"))
        chosen = table.groupBy("k", "h").agg(F.min(F.substring("t", 1, room)).alias("t")).withColumn("place", place).filter(F.col("place") <= rows)
        for r in sorted(chosen.collect(), key=lambda r: r["place"]):
            out.setdefault(r["k"], []).append(r["t"])

    take(hashed.filter(share <= bounds[F.col("k")]))
    few = [v for v, n in counts.items() if len(out.get(v, [])) < min(rows, n) and 4.0 * rows < n]
    if few:  # mostly copies: their distinct texts are fewer than their rows let expect
        for v in few:
            out.pop(v, None)
        take(hashed.filter(F.col("k").isin(few)))
    return out
