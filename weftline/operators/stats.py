"""Element statistics of tensors in the exploded layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy(by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg((F.col("x") == 0).cast("double")).alias("sparsity"))


def histogram(cells: DataFrame, by: str, bins: int = 50) -> DataFrame:
    """Even bins from lowest to highest value, the last one closed; constant values take half a unit on each side."""
    edges = cells.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    slot = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
    return cells.join(edges, by).groupBy(by, slot.alias("bin")).agg(F.count("x").alias("n"))


def memory(model: DataFrame, bytes_each: int = 4) -> DataFrame:
    return model.agg(F.sum(F.size("values").cast("long") * bytes_each).alias("bytes"))
