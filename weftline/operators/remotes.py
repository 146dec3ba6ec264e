"""Moving objects between a local and a remote table of hashes: plans, results, remote registry and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import store

REMOTES = "name string, url string, kind string, bucket string, version long"


def plan(local: DataFrame, remote: DataFrame, direction: str = "both", force: bool = False, subset: DataFrame | None = None) -> DataFrame:
    """`hash, action` (push or pull): what has to move; with `force` everything that the sending side has, with `subset` only of these."""
    if direction not in ("push", "pull", "both"):
        raise ValueError(f"unknown direction {direction}")
    parts = []
    if direction != "pull":
        parts.append(store.to_push(local.select("hash").distinct(), remote, subset, force).withColumn("action", F.lit("push")))
    if direction != "push":
        parts.append(store.to_push(remote.select("hash").distinct(), local, subset, force).withColumn("action", F.lit("pull")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def result(planned: DataFrame, sizes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per action: objects, bytes, errors and whether there were none. `errors` has `hash`; objects without a size count 0 bytes."""
    rows = planned.join(sizes.select("hash", "bytes"), "hash", "left")
    failed = F.lit(False)
    if errors is not None:
        rows = rows.join(errors.select("hash").distinct().withColumn("failed", F.lit(True)), "hash", "left")
        failed = F.coalesce("failed", F.lit(False))
    out = rows.groupBy("action").agg(F.count_if(~failed).alias("moved"), F.coalesce(F.sum(F.when(~failed, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(failed).alias("errors"))
    return out.withColumn("success", F.col("errors") == 0)


def after(local: DataFrame, remote: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' hashes once the plan is carried out."""
    pulled, pushed = planned.filter("action = 'pull'").select("hash"), planned.filter("action = 'push'").select("hash")
    return local.select("hash").union(pulled).distinct(), remote.select("hash").union(pushed).distinct()


class Remotes:
    """Registry of remotes under one folder; the newest row of a name counts, one without a URL is a removal."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows = spark, store.ObjectStore(spark, path)

    def list(self) -> DataFrame:
        rows = self.rows.read()
        rows = self.spark.createDataFrame([], REMOTES) if rows is None else rows
        newest = rows.groupBy("name").agg(F.max_by(F.struct("url", "kind", "bucket"), "version").alias("r"))
        return newest.select("name", "r.*").filter("url is not null")

    def get(self, name: str):
        return self.list().filter(F.col("name") == name).first()

    def _put(self, name: str, url: str | None, kind: str | None, bucket: str | None) -> None:
        rows = self.rows.read()
        version = 0 if rows is None else rows.agg(F.max("version").alias("v")).first()["v"]
        self.spark.createDataFrame([(name, url, kind, bucket, version + 1)], REMOTES).write.mode("append").parquet(self.rows.path)

    def add(self, name: str, url: str) -> None:
        kind, _, rest = url.partition("://")
        if kind not in ("s3", "minio", "file") or not rest:
            raise ValueError(f"can't use {url}: known are s3://, minio:// and file://")
        if self.get(name) is not None:
            raise ValueError(f"remote {name} exists")
        parts = rest.split("/")
        self._put(name, url, "file" if kind == "file" else "s3", parts[0] if kind == "s3" else parts[1] if kind == "minio" and len(parts) > 1 else None)

    def remove(self, name: str) -> None:
        if self.get(name) is None:
            raise ValueError(f"no remote {name}")
        self._put(name, None, None, None)
