"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate with map-side combining and an equi-join, so a hub with a third of all edges is split like
any other skewed key. Null ends and loops are ignored; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` (smallest node reachable) for every node that has an edge."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    pairs = materialize(pairs, "edges")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        after = materialize(small, "small-star")
        release(pairs, large)
        pairs, before, state = after, state, _state(after)
        if state == before:
            out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out._weftline_path = pairs._weftline_path  # so that it can be released
            return out


def _state(pairs: DataFrame):
    return tuple(pairs.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
