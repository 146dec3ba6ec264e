"""The versioned-tensor tables that the registered queries read, derived from the driver's tables; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`name, grp, values`: one tensor for each vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("values"))


def tuned_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base after tuning: four classes of change by name modulo 5, the fifth is dropped."""
    v, k = F.col("values"), F.col("name") % 5
    noisy = F.transform(v, lambda x, i: x + 0.001 * (((F.col("name") + i) % 7) - 3))
    changed = F.when(k == 0, v).when(k == 1, F.transform(v, lambda x: x * 1.05)).when(k == 2, F.transform(v, lambda x: x * 1.2)).otherwise(noisy)
    return base_model(spark, sf_dir).filter(k < 4).withColumn("values", changed)


MODELS_SQL = """
base AS (SELECT vec_id AS name, label AS grp, embedding::DOUBLE[] AS v FROM embeddings),
ft AS (SELECT name, grp, CASE name % 5 WHEN 0 THEN v WHEN 1 THEN list_transform(v, lambda x: x * 1.05) WHEN 2 THEN list_transform(v, lambda x: x * 1.2)
  ELSE list_transform(v, lambda x, i: x + 0.001::DOUBLE * (((name + i - 1) % 7) - 3)) END AS v FROM base WHERE name % 5 < 4),
bx AS (SELECT name, grp, unnest(range(len(v))) AS pos, unnest(v) AS x FROM base),
fx AS (SELECT name, grp, unnest(range(len(v))) AS pos, unnest(v) AS x FROM ft)
"""


def elements(model: DataFrame) -> DataFrame:
    """The exploded layout: `name, grp, pos, x`."""
    return model.select("name", "grp", F.posexplode("values").alias("pos", "x"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit graph: `child, parent, place`; every tenth commit is a merge of its parent and the commit before that."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child")).filter("child > 1")
    first = part.select("child", F.floor(F.col("child") / 2).cast("long").alias("parent"), F.lit(0).alias("place"))
    merges = part.filter("child % 10 = 0").select("child", (F.floor(F.col("child") / 2) - 1).cast("long").alias("parent"), F.lit(1).alias("place")).filter("parent > 0")
    return first.unionByName(merges)


EDGES_SQL = """
edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent, 0 AS place FROM part WHERE p_partkey > 1
  UNION ALL SELECT p_partkey, p_partkey // 2 - 1, 1 FROM part WHERE p_partkey > 1 AND p_partkey % 10 = 0 AND p_partkey // 2 - 1 > 0)
"""


def manifest(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """`name, hash`: what version 0 (base), 1 (ours) or 2 (theirs) holds; drawn from line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    n = F.col("name")
    if version == 0:
        return lines.filter(n % 11 != 0).select("name", F.col("low").alias("hash"))
    keep, change = (n % 7 != 0, n % 3 == 0) if version == 1 else (n % 5 != 0, n % 4 == 0)
    return lines.filter(keep).select("name", F.when(change, F.col("high") + (version if version == 2 else 0) * (n % 2)).otherwise(F.col("low")).alias("hash"))


MANIFEST_SQL = """
lines AS (SELECT l_partkey AS name, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY l_partkey),
m0 AS (SELECT name, low AS hash FROM lines WHERE name % 11 <> 0),
m1 AS (SELECT name, CASE WHEN name % 3 = 0 THEN high ELSE low END AS hash FROM lines WHERE name % 7 <> 0),
m2 AS (SELECT name, CASE WHEN name % 4 = 0 THEN high + 2 * (name % 2) ELSE low END AS hash FROM lines WHERE name % 5 <> 0)
"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run, seq, step, epoch, loss`: training events of each run in order."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("run"), seq.alias("seq"), F.col("value").alias("loss")).withColumns({"step": F.col("seq") * 10, "epoch": F.floor(F.col("seq") / 8).cast("int")})


CHECKPOINTS_SQL = """
ck AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS loss FROM events),
cp AS (SELECT run, seq, loss, seq * 10 AS step, seq // 8 AS epoch FROM ck)
"""
