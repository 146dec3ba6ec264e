"""Layer-by-layer comparison of two models and diffs of two manifests. A model is `name, grp, values`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import similarity as S

CHANGED = 1e-6


def _tensors(model: DataFrame, side: str) -> DataFrame:
    """Values, and shape and dtype where the model has them, named after the side."""
    return model.select("name", F.col("values").alias(f"v{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("shape", "dtype") if c in model.columns))


def compatible(a: DataFrame, b: DataFrame) -> Column:
    """Over a join of `_tensors`: equal lengths, and equal shapes and dtypes where both models state them."""
    out = F.size("va") == F.size("vb")
    for c in ("shape", "dtype"):
        if c in a.columns and c in b.columns:
            out &= F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return out


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per layer name: where it is, similarities, and statistics of b - a. Layers of different length have similarity 0."""
    joined = _tensors(a, "a").join(_tensors(b, "b"), "name", "full_outer")
    where = F.when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").when(~compatible(a, b), "mismatch").otherwise("both")
    joined = joined.withColumn("status", where)
    both = F.col("status") == "both"
    delta = F.when(both, F.zip_with("vb", "va", lambda y, x: y - x))
    n = F.size("va")
    out = joined.withColumns({"delta": delta, "cos": F.when(both, S.cosine(F.col("va"), F.col("vb"))), "mag": F.when(both, S.magnitude(F.col("va"), F.col("vb")))})
    mean = S.total(F.col("delta")) / n
    square = S.total(F.transform("delta", lambda d: d * d)) / n
    return out.select(
        "name",
        "status",
        "cos",
        "mag",
        F.when(both, S.hybrid(F.col("cos"), F.col("mag"))).when(F.col("status") == "mismatch", 0.0).alias("similarity"),
        mean.alias("mean_delta"),
        S.total(F.transform("delta", F.abs)).__truediv__(n).alias("mean_abs_delta"),
        F.array_max(F.transform("delta", F.abs)).alias("max_abs_delta"),
        F.sqrt(square).alias("rmse"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_delta"),
        F.size(F.filter("delta", lambda d: F.abs(d) > CHANGED)).cast("long").alias("changed"),
        F.when(both, n).cast("long").alias("params"),
    )


def summary(compared: DataFrame) -> DataFrame:
    both = F.col("status") == "both"
    return compared.agg(
        F.count_if(both).alias("common"),
        F.count_if(F.col("status") == "only_a").alias("only_a"),
        F.count_if(F.col("status") == "only_b").alias("only_b"),
        F.sum("params").alias("params"),
        F.sum(F.when(both, F.col("changed"))).alias("changed"),
        F.avg("similarity").alias("mean_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
    )


def category(similarity: Column) -> Column:
    return F.when(similarity >= 0.9999, "identical").when(similarity >= 0.99, "minor").when(similarity >= 0.9, "moderate").otherwise("major")


def categories(compared: DataFrame) -> DataFrame:
    """Layers of each category; all four have a row."""
    found = compared.filter("similarity is not null").groupBy(category(F.col("similarity")).alias("category")).count()
    every = compared.sparkSession.createDataFrame([(c,) for c in ("identical", "minor", "moderate", "major")], "category string")
    return every.join(found, "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("layers"))


def most_changed(compared: DataFrame, limit: int = 10) -> DataFrame:
    return compared.filter("similarity is not null").orderBy("similarity", "name").limit(limit)


def relative_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and largest |a-b| / (|a|+|b|+1e-10), and the root mean square of a-b, for each common layer."""
    pair = a.select("name", F.col("values").alias("va")).join(b.select("name", F.col("values").alias("vb")), "name").filter(F.size("va") == F.size("vb"))
    relative = F.zip_with("va", "vb", lambda x, y: F.abs(x - y) / (F.abs(x) + F.abs(y) + 1e-10))
    squares = F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y))
    return pair.select("name", (S.total(relative) / F.size("va")).alias("mean_relative"), F.array_max(relative).alias("max_relative"), F.sqrt(S.total(squares) / F.size("va")).alias("rmse"))


def diff_values(a: DataFrame, b: DataFrame, absolute: float = 1e-7) -> DataFrame:
    """Checkpoint diff: added, removed, unchanged or changed layers with their cosine; another length counts as changed with 0."""
    pair = a.select("name", F.col("values").alias("va")).join(b.select("name", F.col("values").alias("vb")), "name", "full_outer")
    same = (F.size("va") == F.size("vb")) & S.allclose(F.col("va"), F.col("vb"), absolute)
    state = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    cos = F.when(F.size("va") != F.size("vb"), 0.0).otherwise(S.cosine(F.col("va"), F.col("vb")))
    return pair.select("name", state.alias("state"), F.when(state == "changed", cos).alias("similarity"))


def diff_parameters(saved: DataFrame, current: DataFrame, absolute: float = 1e-6, relative: float = 1e-5) -> DataFrame:
    """`name, state` of a checkpoint against a model: identical (allclose), modified, shape_mismatch, saved_only, model_only; with the largest difference."""
    pair = saved.select("name", F.col("values").alias("va")).join(current.select("name", F.col("values").alias("vb")), "name", "full_outer")
    state = F.when(F.col("va").isNull(), "model_only").when(F.col("vb").isNull(), "saved_only").when(F.size("va") != F.size("vb"), "shape_mismatch")
    state = state.when(S.allclose(F.col("va"), F.col("vb"), absolute, relative), "identical").otherwise("modified")
    largest = F.when(F.size("va") == F.size("vb"), F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y))))
    return pair.select("name", state.alias("state"), largest.alias("largest"))


def within(saved: DataFrame, current: DataFrame, tolerance: float) -> DataFrame:
    """As `diff_parameters`, but identical means that no element differs by more than `tolerance`."""
    return diff_parameters(saved, current, tolerance, 0.0)


def bucketed(a: DataFrame, b: DataFrame, threshold: float = 0.99, tolerance: float = 0.1) -> DataFrame:
    """`name, bucket, score` of common layers: identical values, similar (direction and magnitude), or different; with the hybrid score."""
    pair = a.select("name", F.col("values").alias("va")).join(b.select("name", F.col("values").alias("vb")), "name")
    pair = pair.withColumns({"cos": S.cosine(F.col("va"), F.col("vb")), "mag": S.magnitude(F.col("va"), F.col("vb"))})
    close = (F.size("va") == F.size("vb")) & (F.col("cos") >= threshold) & (F.col("mag") >= 1.0 - tolerance)
    bucket = F.when(F.col("va") == F.col("vb"), "identical").when(close, "similar").otherwise("different")
    return pair.select("name", bucket.alias("bucket"), F.when(F.size("va") == F.size("vb"), S.hybrid(F.col("cos"), F.col("mag"))).otherwise(0.0).alias("score"))


def reusable_share(buckets: DataFrame) -> DataFrame:
    """Layers per bucket and the share in percent that needn't be transferred; null without common layers."""
    count = lambda k: F.count_if(F.col("bucket") == k)
    out = buckets.agg(count("identical").alias("identical"), count("similar").alias("similar"), count("different").alias("different"))
    total = F.col("identical") + F.col("similar") + F.col("different")
    return out.withColumn("percent", F.when(total > 0, (F.col("identical") + F.col("similar")) * 100.0 / total))


def restored(model: DataFrame, saved: DataFrame) -> DataFrame:
    """`name, values, source` of a model into which a checkpoint is loaded: saved values where there are any of the same length, else its own."""
    pair = model.select("name", F.col("values").alias("own")).join(saved.select("name", F.col("values").alias("s")), "name", "left")
    use = F.col("s").isNotNull() & (F.size("s") == F.size("own"))
    return pair.select("name", F.when(use, F.col("s")).otherwise(F.col("own")).alias("values"), F.when(use, "saved").otherwise("model").alias("source"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest diff: `name, state` of everything added, removed or modified between `name, hash` tables."""
    pair = old.select("name", F.col("hash").alias("h0")).join(new.select("name", F.col("hash").alias("h1")), "name", "full_outer")
    state = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    return pair.select("name", state.alias("state"), "h0", "h1").filter("state is not null")


def changed_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` whose (name, hash) isn't in `old`."""
    return new.join(old, ["name", "hash"], "left_anti")


def added_names(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, "name", "left_anti").select("name")


def common_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """`name, hash, conflict` after merging: an unchanged side yields; both changed alike agree; otherwise ours, marked."""
    pick = lambda df, c: df.select("name", F.col("hash").alias(c), F.lit(True).alias(f"has_{c}"))
    rows = pick(ours, "o").join(pick(theirs, "t"), "name", "full_outer").join(pick(base, "b"), "name", "full_outer")
    o, t, b = F.col("o"), F.col("t"), F.col("b")
    same = o.eqNullSafe(t)
    value = F.when(same, o).when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o).otherwise(F.coalesce(o, t))
    conflict = ~same & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    return rows.select("name", value.alias("hash"), conflict.alias("conflict")).filter("hash is not null")
