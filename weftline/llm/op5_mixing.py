"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources share `budget` times all words by weight, and a source stops at `repeat` times its own words, the
excess going to the others by weight until none is above. Training runs over u in [0, 1]. A source's weight changes
linearly, weight * (1 + slope * (2u - 1)); integrated and scaled to its target this is the cumulative demand
target * (u + slope * (u*u - u)). A source's documents stand in a fixed order of a digest of id and text and are read again
from the start where the target exceeds the source; the words before a document in that order are its place on the
demand curve, and the inverse of the curve at that place is the document's training position. The result is
range-sorted by position.

A hot source is never one group: prefix sums run within (source, digest bucket) and add the sums of the buckets before.
Whatever text holds, only ids, sources, sizes and digests are shuffled.

Defined results: null text has size 0; the null source is a source of its own, sorted last; a source without words gets
target 0 and takes nothing; documents without words take nothing; the last document that a target reaches is taken in
part (its first words); repeated rows are separate documents, ties in the order are equal rows; a null id is digested as
the empty text; very long texts count whole and cost one pass; an empty table gives an empty result. Other columns than id, text and source are not carried, so clashing names can't arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, read

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)
BUDGET = 1.5
REPEAT = 2
#: Hex digits of the digest that make a bucket of a source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """`source_rank` from 0 by code point, null last, without sending all sources to one task: ranges are counted first."""
    ranged = sources.withColumn("last", F.col("source").isNull()).repartitionByRange(F.col("last"), F.col("source")).sortWithinPartitions("last", "source")
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    return ranged.withColumn("inside", inside).join(before, "range").withColumn("source_rank", (F.col("inside") + F.col("before")).cast("long")).drop("range", "inside", "before", "last")


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """`source, source_size` to `target` and `slope`. Each round of resharing is one small aggregate over the sources."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("source_rank") % len(values)).cast("int") + 1)
    ranked = materialize(ranked_sources(sources).withColumns({"weight": pick(weights), "slope": pick(slopes), "most": (F.col("source_size") * repeat).cast("double")}), "mix-ranked")
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        row = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * repeat).otherwise(0)).cast("long").alias("stopped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == held or not row["weight"]:
            break
        held, level = row["n"], (total * budget - row["stopped"]) / row["weight"]
    return ranked.select("source", "source_size", "slope", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def position(before: Column, target: Column, slope: Column) -> Column:
    """Training position in [0, 1] at which the cumulative demand reaches `before`; 1 beyond the target."""
    y = F.least(before.cast("double") / target, F.lit(1.0))
    b = F.lit(1.0) - slope
    return F.when(target > 0, F.least(F.lit(1.0), F.coalesce(F.lit(2.0) * y / F.nullif(b + F.sqrt(b * b + F.lit(4.0) * slope * y), F.lit(0.0)), F.lit(0.0)))).otherwise(F.lit(1.0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """Per row: id, `source`, `size`, `source_size`, `target`, `taken` (words, repeats counted), `position` (of the first copy), `before` and `slope`."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))  # null and repeated ids spread by their texts
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    sized = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), digest.alias("digest")), "mix-sizes")
    sized = sized.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    buckets = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, slopes, budget, repeat)
    own = Window.partitionBy("source")
    offsets = buckets.select("source", "bucket", (F.sum("bucket_size").over(own.orderBy("bucket")) - F.col("bucket_size")).alias("bucket_before"))
    placed = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "size", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    right = placed.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_before", "source_size", "target", "slope")
    docs = docs.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    before = F.col("inside") + F.col("bucket_before")
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), goal - before - F.col("source_size") * k)) for k in range(1, repeat)), F.greatest(F.lit(0), F.least(F.col("size"), goal - before)))
    return docs.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), position(before, F.col("target"), F.col("slope")).alias("position"), before.alias("before"), "slope")


def schedule(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix in training order: a range sort by position."""
    return mixed.orderBy("position", id_col)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(mix(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS digest FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][turn + 1]::DOUBLE AS slope, (2 * source_size)::DOUBLE AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM per_source),
stepped AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
level AS (SELECT coalesce(max((budget - stopped) / open_weight), 0) AS level FROM stepped WHERE weight * ((budget - stopped) / open_weight) < most),
aimed AS (SELECT source, source_size, slope, least(most, weight * level) AS target FROM weighed, level),
placed AS (
  SELECT s.*, a.source_size, a.target, a.slope, sum(size) OVER (PARTITION BY s.source ORDER BY digest, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
lines AS (SELECT *, least(before::DOUBLE / target, 1.0) AS y, 1.0::DOUBLE - slope AS b, floor(target + 0.5)::BIGINT AS goal FROM placed)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - before - source_size)))::BIGINT AS taken,
  CASE WHEN target > 0 THEN least(1.0, coalesce(2.0::DOUBLE * y / nullif(b + sqrt(b * b + 4.0::DOUBLE * slope * y), 0.0), 0.0)) ELSE 1.0 END AS position
FROM lines
"""
