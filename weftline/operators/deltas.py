"""Tensors stored as deltas: building them for a commit, the delta table, and putting tensors together again.

A manifest has `name, hash, delta_hash` (null: stored whole); a delta row has `delta_hash, kind, data, reference, meta,
original_bytes`. A tensor's hash is always that of its own values, so what is put together can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import codec
from weftline.operators.store import IntegrityError, ObjectStore


def content_hash(values: Column) -> Column:
    """sha256 of the values' JSON text, which tells all doubles apart."""
    return F.sha2(F.to_json(F.struct(values.alias("values"))).cast("binary"), 256)


def built(pairs: DataFrame, kind: str, least_bytes: int = 512, least_ratio: float = 0.0, bytes_each: int = 4) -> DataFrame:
    """Deltas of `name, reference, va, vb` that are worth it: `name, delta_hash, kind, data, reference, meta, original_bytes, ratio`.

    Tensors of another length, small ones, and those that save `least_ratio` or less have none.
    """
    coded = codec.encode(pairs, kind).filter("data is not null")
    meta = F.to_json(F.struct(F.lit(kind).alias("kind"), F.size("vb").alias("length")))
    coded = coded.withColumns({"meta": meta, "original_bytes": (F.size("vb") * bytes_each).cast("long")})
    coded = coded.withColumn("ratio", 1.0 - codec.stored_bytes(F.col("data"), F.col("meta")) / F.col("original_bytes"))
    name = F.sha2(F.concat(F.col("reference").cast("binary"), F.col("data"), F.col("meta").cast("binary")), 256)
    worth = (F.col("original_bytes") >= least_bytes) & (F.col("ratio") > least_ratio)
    return coded.filter(worth).select("name", name.alias("delta_hash"), F.lit(kind).alias("kind"), "data", "reference", "meta", "original_bytes", "ratio")


def against_parent(current: DataFrame, parent: DataFrame, kind: str, **limits) -> DataFrame:
    """Deltas of a commit's tensors (`name, hash, values`) against the parent's of the same name where they changed."""
    old = parent.select("name", F.col("hash").alias("reference"), F.col("values").alias("va"))
    pairs = current.select("name", F.col("hash").alias("own"), F.col("values").alias("vb")).join(old, "name").filter("own <> reference")
    return built(pairs, kind, **limits)


def reconstructed(manifest: DataFrame, objects: DataFrame, deltas: DataFrame, strict: bool = False) -> DataFrame:
    """`name, hash, values, intact` of a manifest: decoded where there is a delta, else the object itself; what neither has is left out.

    `intact`: the values give the hash. With `strict` the first one that doesn't raises IntegrityError.
    """
    found = manifest.join(deltas.select("delta_hash", "kind", "data", "reference"), "delta_hash", "left")
    found = found.join(objects.select(F.col("hash").alias("reference"), F.col("values").alias("va")), "reference", "left")
    found = codec.decode(found).join(objects.select("hash", F.col("values").alias("own")), "hash", "left")
    out = found.select("name", "hash", F.coalesce("restored", "own").alias("values")).filter("values is not null")
    out = out.withColumn("intact", content_hash(F.col("values")) == F.col("hash"))
    if strict:
        wrong = out.filter("not intact").select("name", "hash", content_hash(F.col("values")).alias("actual")).first()
        if wrong is not None:
            raise IntegrityError(wrong["hash"], wrong["actual"], wrong["name"])
    return out


def storage_info(deltas: DataFrame) -> DataFrame:
    """How many deltas there are, their payload bytes and the originals' bytes."""
    return deltas.agg(F.count("delta_hash").alias("deltas"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("data_bytes"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"))


def delta_of(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """`name, delta_hash, encoded` of each wanted name."""
    return names.select("name").join(manifest.select("name", "delta_hash"), "name", "left").withColumn("encoded", F.col("delta_hash").isNotNull())


class DeltaStore(ObjectStore):
    """Delta rows under one folder, one for each `delta_hash`."""

    def __init__(self, spark: SparkSession, path: str, **more):
        super().__init__(spark, path, **more)

    def add(self, rows: DataFrame) -> None:
        super().add(rows.withColumnRenamed("delta_hash", "hash"))

    def table(self) -> DataFrame:
        rows = self.read()
        if rows is None:
            return self.spark.createDataFrame([], "delta_hash string, kind string, data binary, reference string, meta string, original_bytes long, ratio double")
        return rows.withColumnRenamed("hash", "delta_hash")
