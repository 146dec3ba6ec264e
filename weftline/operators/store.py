"""Content-addressed objects as tables: insert if absent, lookups, statistics, garbage, and syncing two stores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import similarity as S


class IntegrityError(ValueError):
    """A stored row whose content doesn't give its hash: `expected`, `actual` and the object's `name`."""

    def __init__(self, expected: str, actual: str, name: str | None = None):
        super().__init__(f"{name or 'object'} should have hash {expected} and has {actual}")
        self.expected, self.actual, self.name = expected, actual, name


class WeightStore(Protocol):
    """What a store of objects offers, whatever is below it."""

    def read(self) -> DataFrame | None: ...
    def add(self, rows: DataFrame) -> None: ...
    def load(self, hashes: DataFrame, verify: str | None = None, strict: bool = True) -> DataFrame: ...
    def exists(self, hashes: DataFrame) -> DataFrame: ...
    def delete(self, hashes: DataFrame) -> None: ...
    def list(self) -> DataFrame: ...
    def metadata(self, hashes: DataFrame | None = None) -> DataFrame: ...
    def info(self) -> DataFrame: ...


class ObjectStore:
    """`hash` and other columns under one folder of Parquet files; single writer, appends only add hashes not yet there."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "a", compression: str = "zstd", large: tuple[str, ...] = ("values", "data")):
        if mode not in ("r", "a", "w"):
            raise ValueError(f"unknown mode {mode}")
        if compression not in ("zstd", "gzip", "snappy", "lz4", "none"):
            raise ValueError(f"unknown compression {compression}")
        self.spark, self.path, self.mode, self.compression, self.large = spark, path, mode, compression, large
        if mode == "w":
            self._files()[0].delete(self._files()[1], True)

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise

    def add(self, rows: DataFrame) -> None:
        if self.mode == "r":
            raise PermissionError(f"{self.path} is open for reading only")
        have = self.read()
        absent(rows, have).write.mode("append").option("compression", self.compression).parquet(self.path)

    def load(self, hashes: DataFrame, verify: str | None = None, strict: bool = True) -> DataFrame:
        """Rows of the wanted hashes, those that aren't there left out; with `verify`, the column that sha256 must give the hash of.

        A row that fails raises IntegrityError; if not `strict`, `intact` tells.
        """
        found = self.spark.read.parquet(self.path).join(hashes.select("hash").distinct(), "hash", "left_semi")
        if verify is None:
            return found
        own = F.sha2(F.col(verify).cast("binary"), 256)
        if not strict:
            return found.withColumn("intact", own.eqNullSafe(F.col("hash")))
        wrong = found.filter(~own.eqNullSafe(F.col("hash"))).select("hash", own.alias("own"), *(["name"] if "name" in found.columns else [])).first()
        if wrong is not None:
            raise IntegrityError(wrong["hash"], wrong["own"], wrong["name"] if "name" in found.columns else None)
        return found

    def exists(self, hashes: DataFrame) -> DataFrame:
        return present(hashes, self._rows().select("hash"))

    def delete(self, hashes: DataFrame) -> None:
        """Rewrites the folder without the hashes: the new files first, then they take the old ones' place."""
        if self.mode == "r":
            raise PermissionError(f"{self.path} is open for reading only")
        if self.read() is None:
            return
        kept = f"{self.path}.kept"
        self.read().join(hashes.select("hash").distinct(), "hash", "left_anti").write.mode("overwrite").option("compression", self.compression).parquet(kept)
        files, where = self._files()
        files.delete(where, True)
        files.rename(self.spark._jvm.org.apache.hadoop.fs.Path(kept), where)

    def list(self) -> DataFrame:
        return self._rows().select("hash")

    def metadata(self, hashes: DataFrame | None = None) -> DataFrame:
        """All columns but the large ones, which aren't read."""
        rows = self._rows()
        rows = rows.select(*(c for c in rows.columns if c not in self.large))
        return rows if hashes is None else rows.join(hashes.select("hash").distinct(), "hash", "left_semi")

    def info(self) -> DataFrame:
        return info(self._rows())

    def batches(self, hashes: DataFrame | None = None, size: int = 100) -> Iterator[list]:
        """Rows in order of hash, `size` at a time, one partition in the driver at once; missing hashes are passed over."""
        rows = self._rows() if hashes is None else self.load(hashes)
        part: list = []
        for row in rows.orderBy("hash").toLocalIterator():
            part.append(row)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    def _rows(self) -> DataFrame:
        rows = self.read()
        return self.spark.createDataFrame([], "hash string, raw_bytes long, stored_bytes long") if rows is None else rows


def open_store(spark: SparkSession, url: str, **more) -> ObjectStore:
    """A store behind a URL: file:// or a plain path, s3:// through Spark's own s3a file system, minio://host:port/bucket/... likewise with its endpoint."""
    kind, found, rest = url.partition("://")
    if not found or kind == "file":
        return ObjectStore(spark, url, **more)
    if kind == "s3":
        return ObjectStore(spark, f"s3a://{rest}", **more)
    if kind == "minio":
        host, _, path = rest.partition("/")
        settings = spark._jsc.hadoopConfiguration()
        bucket = path.partition("/")[0]
        settings.set(f"fs.s3a.bucket.{bucket}.endpoint", f"http://{host}")
        settings.set(f"fs.s3a.bucket.{bucket}.path.style.access", "true")
        return ObjectStore(spark, f"s3a://{path}", **more)
    raise ValueError(f"can't open {url}: known are file://, s3:// and minio://")


def copied(source: ObjectStore, target: ObjectStore, hashes: DataFrame | None = None) -> dict[str, int]:
    """Copies what the target lacks, of all objects or of the wanted ones; how many were copied and how many were there."""
    rows = source._rows() if hashes is None else source.load(hashes)
    total, missing = rows.select("hash").distinct().count(), absent(rows.select("hash"), target.read()).count()
    target.add(rows)
    return {"copied": missing, "skipped": total - missing}


def present(hashes: DataFrame, have: DataFrame) -> DataFrame:
    """`hash, found` for each wanted hash."""
    flagged = have.select("hash").distinct().withColumn("found", F.lit(True))
    return hashes.select("hash").distinct().join(flagged, "hash", "left").select("hash", F.coalesce("found", F.lit(False)).alias("found"))


def metadata(tensors: DataFrame, bytes_each: int = 4) -> DataFrame:
    """`name, size, nbytes` from `shape` alone (1 element for an empty shape)."""
    size = S.element_count(F.col("shape"))
    return tensors.select("name", size.alias("size"), (size * bytes_each).alias("nbytes"))


def absent(rows: DataFrame, have: DataFrame | None) -> DataFrame:
    """Rows to insert: one per hash, none that is there already."""
    rows = rows.dropDuplicates(["hash"])
    return rows if have is None else rows.join(have.select("hash"), "hash", "left_anti")


def info(objects: DataFrame) -> DataFrame:
    out = objects.agg(F.count("hash").alias("objects"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("stored_bytes").alias("stored_bytes"))
    return out.withColumn("ratio", F.when(F.col("raw_bytes") > 0, 1.0 - F.col("stored_bytes") / F.col("raw_bytes")).otherwise(0.0))


def garbage(objects: DataFrame, *referenced: DataFrame) -> DataFrame:
    """Objects that no manifest, delta or other `hash` table names."""
    out = objects
    for r in referenced:
        out = out.join(r.select("hash"), "hash", "left_anti")
    return out


def sync_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    pair = local.select(F.col("hash").alias("l")).distinct().join(remote.select(F.col("hash").alias("r")).distinct(), F.col("l") == F.col("r"), "full_outer")
    out = pair.agg(F.count_if(F.col("r").isNull()).alias("ahead"), F.count_if(F.col("l").isNull()).alias("behind"), F.count_if(F.col("l") == F.col("r")).alias("synced"))
    return out.withColumn("is_synced", (F.col("ahead") == 0) & (F.col("behind") == 0))


def to_push(local: DataFrame, remote: DataFrame, subset: DataFrame | None = None, force: bool = False) -> DataFrame:
    rows = local if subset is None else local.join(subset.select("hash"), "hash", "left_semi")
    return rows if force else rows.join(remote.select("hash"), "hash", "left_anti")


def repository_stats(manifests: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of `commit, name, hash` and `hash, bytes`: commits, references, distinct objects, repeats and the objects' bytes."""
    totals = manifests.agg(F.countDistinct("commit").alias("commits"), F.count("hash").alias("refs"), F.countDistinct("hash").alias("unique_objects"))
    held = sizes.join(manifests.select("hash").distinct(), "hash", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return totals.crossJoin(F.broadcast(held)).select("commits", "refs", "unique_objects", (F.col("refs") - F.col("unique_objects")).alias("duplicates"), "bytes")  # one row each


def memory_stats(tensors: DataFrame, budget: int, bytes_each: int = 4) -> DataFrame:
    """Of tensors with `loaded`: how many and how many bytes, in all and loaded, and the used share of a budget of bytes."""
    size = (F.size("values") * bytes_each).cast("long")
    out = tensors.agg(F.count(F.lit(1)).alias("tensors"), F.count_if("loaded").alias("loaded"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("loaded"), size)), F.lit(0)).alias("loaded_bytes"))
    return out.withColumn("used", F.col("loaded_bytes") / F.lit(budget))


def newest_refs(rows: DataFrame) -> DataFrame:
    """`name, kind, commit` of references written as versions: the newest counts, one without a commit is a deletion."""
    newest = rows.groupBy("name", "kind").agg(F.max_by(F.struct("commit"), "version").alias("r"))
    return newest.select("name", "kind", "r.commit").filter("commit is not null")


def versions(tags: DataFrame) -> DataFrame:
    """Tags of `name, commit` with their `version_id`."""
    return tags.withColumn("version_id", F.left(F.sha2(F.concat_ws(":", "name", "commit").cast("binary"), 256), F.lit(16)))


def referring(manifests: DataFrame, hashes: DataFrame) -> DataFrame:
    """Commits that hold any of the hashes."""
    return manifests.join(hashes.select("hash"), "hash", "left_semi").select("commit").distinct()


def resolve(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`ref, commit`: exact commit, then branch, then tag, then a commit's beginning; the smallest commit among several."""
    kinds = F.when(F.col("kind") == "commit", 0).when(F.col("kind") == "branch", 1).otherwise(2)
    exact = wanted.join(refs.select("name", "commit", kinds.alias("rank")), F.col("ref") == F.col("name")).select("ref", "commit", "rank")
    # only beginnings of the lengths that are asked for are made
    lengths = wanted.select(F.length("ref").alias("n")).distinct()
    short = refs.filter("kind = 'commit'").join(F.broadcast(lengths.filter("n between 4 and 256")), F.col("n") < F.length("name")).withColumn("short", F.expr("substring(name, 1, n)"))
    prefix = wanted.join(short, F.col("ref") == F.col("short")).select("ref", "commit", F.lit(3).alias("rank"))
    return exact.unionByName(prefix).groupBy("ref").agg(F.min_by("commit", F.struct("rank", "commit")).alias("commit"))


def renamed(weights: DataFrame, names: dict[str, str], prefix: str = "") -> DataFrame:
    """Names from the map, others with the prefix."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    mapped = F.element_at(F.create_map(*pairs), F.col("name")) if pairs else F.lit(None).cast("string")
    return weights.withColumn("name", F.coalesce(mapped, F.concat(F.lit(prefix), "name")))


def key_check(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """`name, problem`: names a model needs and the checkpoint lacks (missing), and the other way round (unexpected)."""
    missing = wanted.select("name").join(loaded.select("name"), "name", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(loaded.select("name").join(wanted.select("name"), "name", "left_anti").withColumn("problem", F.lit("unexpected")))


def transfer_savings(items: DataFrame) -> DataFrame:
    """Of `bytes, cached`: what was moved, what was saved, and the saved share in percent (0 for nothing)."""
    out = items.agg(F.coalesce(F.sum(F.when(~F.col("cached"), F.col("bytes"))), F.lit(0)).alias("moved"), F.coalesce(F.sum(F.when(F.col("cached"), F.col("bytes"))), F.lit(0)).alias("saved"))
    both = F.col("moved") + F.col("saved")
    return out.withColumn("percent", F.when(both > 0, F.col("saved") * 100.0 / both).otherwise(0.0))


def newest(publishes: DataFrame, limit: int = 50) -> DataFrame:
    """Successful publishes, newest first."""
    return publishes.filter("ok").orderBy(F.desc("at"), F.desc("id")).limit(limit)
