"""Reading tensor files as rows `path, name, dtype, shape, values`: .npy/.npz archives and safetensors files.

Files are listed and read by Spark's binaryFile source; each is parsed in the task that holds it, bad ones give a row
with `error` instead of failing the scan.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, name string, dtype string, shape array<int>, values array<double>, error string"
_KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "?"}


def _numpy_items(path: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    stem, suffix = os.path.splitext(os.path.basename(path))
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if suffix == ".npz":
        for name in loaded.files:
            yield name, loaded[name]
    else:
        yield stem, loaded


def safetensors_items(content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Header length (8 bytes, little-endian), JSON header, then the tensors' bytes; bfloat16 is widened to float32."""
    size = int.from_bytes(content[:8], "little")
    header = json.loads(content[8 : 8 + size])
    data = memoryview(content)[8 + size :]
    for name, item in header.items():
        if name == "__metadata__":
            continue
        a, b = item["data_offsets"]
        if item["dtype"] == "BF16":
            values = (np.frombuffer(data[a:b], "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            values = np.frombuffer(data[a:b], _KINDS[item["dtype"]])
        yield name, values.reshape(item["shape"])


def _read(spark: SparkSession, folder: str, pattern: str, items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for name, x in items(path, content):
                        rows.append((path, name, x.dtype.name, list(x.shape), x.astype(np.float64).ravel(), None))
                except Exception as e:  # a bad file is data, not a failure of the scan
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "dtype", "shape", "values", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_numpy(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "*.np[yz]", _numpy_items)


def read_safetensors(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "*.safetensors", lambda path, content: safetensors_items(content))


def content_hash(model: DataFrame) -> DataFrame:
    """Adds `hash`: xxh3-64 of shape, type name and little-endian bytes, so equal bytes of another shape or type differ."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def digest(shape, dtype, values):
        import pandas as pd
        import xxhash

        return pd.Series([xxhash.xxh3_64_hexdigest(str(tuple(int(n) for n in s)).encode() + t.encode() + np.asarray(v, t).tobytes()) for s, t, v in zip(shape, dtype, values, strict=True)])

    return model.withColumn("hash", digest("shape", "dtype", "values"))


def publish(model: DataFrame, target: str, kind: str = "npz", metadata: dict | None = None) -> list[str]:
    """Writes a model's tensors to a folder, one file (npz) or one per task (safetensors), with metadata beside; paths of what was written.

    npz is written by the driver tensor by tensor and is for models that fit a disk; safetensors parts are written by the
    tasks that hold them, each under a name of its own, so a task that is run again writes its file again.
    """
    from pathlib import Path

    if kind not in ("npz", "safetensors"):
        raise ValueError(f"unknown format {kind}")
    folder = Path(target)
    folder.mkdir(parents=True, exist_ok=True)
    if kind == "npz":
        import zipfile

        path = folder / "model.npz"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for row in model.select("name", "values").toLocalIterator():
                with out.open(f"{row['name']}.npy", "w", force_zip64=True) as item:
                    np.lib.format.write_array(item, np.asarray(row["values"], np.float32))
        written = [str(path)]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = {n: np.asarray(v, np.float32) for b in batches for n, v in zip(map(str, b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True)}
            if rows:
                path = folder / f"part-{TaskContext.get().partitionId():05d}.safetensors"
                half = path.with_suffix(f".{TaskContext.get().taskAttemptId()}")
                half.write_bytes(safetensors_bytes(rows))
                half.replace(path)
                yield pa.RecordBatch.from_arrays([pa.array([str(path)])], names=["path"])

        written = sorted(r["path"] for r in model.select("name", "values").mapInArrow(run, "path string").collect())
    (folder / "metadata.json").write_text(json.dumps({"format": kind, **(metadata or {})}, sort_keys=True))
    return [*written, str(folder / "metadata.json")]


def safetensors_bytes(rows: dict[str, np.ndarray]) -> bytes:
    header, at = {}, 0
    for name, x in rows.items():
        header[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    text = json.dumps(header).encode()
    return len(text).to_bytes(8, "little") + text + b"".join(x.astype("<f4").tobytes() for x in rows.values())
