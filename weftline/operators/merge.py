"""Combining models: averages, task vectors, sign-elected sparse merging. Exploded layout `name, pos, x`, one aggregate each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("name", "pos")


def stacked(models: list[DataFrame]) -> DataFrame:
    """All models' elements with `model`, their number."""
    out = None
    for i, m in enumerate(models):
        rows = m.select(*KEY, "x").withColumn("model", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no models")
    return out


def weighted_soup(models: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean over the models that have the element."""
    weights = weights or [1.0] * len(models)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("model") + 1)
    return stacked(models).groupBy(*KEY).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"))


def interpolate(ours: DataFrame, theirs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * ours + (1 - alpha) * theirs; ours where theirs has no such element, and the other way round."""
    pair = ours.select(*KEY, F.col("x").alias("o")).join(theirs.select(*KEY, F.col("x").alias("t")), list(KEY), "full_outer")
    return pair.select(*KEY, F.when(F.col("o").isNotNull() & F.col("t").isNotNull(), alpha * F.col("o") + (1 - alpha) * F.col("t")).otherwise(F.coalesce("o", "t")).alias("x"))


def task_vectors(model: DataFrame, base: DataFrame) -> DataFrame:
    """model - base; elements that the base lacks stay as they are."""
    return model.select(*KEY, "x").join(base.select(*KEY, F.col("x").alias("b")), list(KEY), "left").select(*KEY, (F.col("x") - F.coalesce("b", F.lit(0.0))).alias("x"))


def task_arithmetic(models: list[DataFrame], base: DataFrame, scale: float = 1.0) -> DataFrame:
    """base + scale * sum of task vectors."""
    deltas = stacked([task_vectors(m, base) for m in models]).groupBy(*KEY).agg(F.sum("x").alias("d"))
    return _onto(base, deltas, scale)


def trim(vectors: DataFrame, density: float, *by: str) -> DataFrame:
    """Keeps of each tensor the values at least as large as its k-th largest, k = max(1, floor(n * density)); ties stay, others are 0."""
    own = Window.partitionBy(*by, "name")
    keep = F.rank().over(own.orderBy(F.abs("x").desc())) <= F.greatest(F.lit(1), F.floor(F.count("x").over(own) * density))
    return vectors.withColumn("x", F.when(keep, F.col("x")).otherwise(0.0))


def ties(models: list[DataFrame], base: DataFrame, density: float = 0.5, elect: str = "total", scale: float = 1.0) -> DataFrame:
    """Trim, elect a sign for each element (by mass or by number of models), average the values that agree, add to the base."""
    x = F.col("x")
    rows = trim(stacked([task_vectors(m, base) for m in models]), density, "model")
    up = F.sum(F.greatest(x, F.lit(0.0))) if elect == "total" else F.count_if(x > 0).cast("double")
    down = F.sum(F.greatest(-x, F.lit(0.0))) if elect == "total" else F.count_if(x < 0).cast("double")
    agg = rows.groupBy(*KEY).agg(
        up.alias("up"), down.alias("down"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("pos_sum"), F.count_if(x > 0).alias("pos_n"),
        F.sum(F.when(x < 0, x).otherwise(0.0)).alias("neg_sum"), F.count_if(x < 0).alias("neg_n"),
    )
    positive = F.col("up") >= F.col("down")
    mean = F.when(positive, F.col("pos_sum") / F.greatest(F.col("pos_n"), F.lit(1))).otherwise(F.col("neg_sum") / F.greatest(F.col("neg_n"), F.lit(1)))
    return _onto(base, agg.select(*KEY, mean.alias("d")), scale)


def ties_counts(models: list[DataFrame], base: DataFrame, density: float = 0.5) -> DataFrame:
    """`trimmed` values, and `conflicts`: elements for which kept values of both signs remain."""
    x = F.col("x")
    rows = trim(stacked([task_vectors(m, base) for m in models]), density, "model")
    before = stacked([task_vectors(m, base) for m in models]).agg(F.count_if(x != 0).alias("n"))
    cells = rows.groupBy(*KEY).agg(F.count_if(x > 0).alias("up"), F.count_if(x < 0).alias("down"))
    out = cells.agg(F.sum(F.col("up") + F.col("down")).alias("kept"), F.count_if((F.col("up") > 0) & (F.col("down") > 0)).alias("conflicts"))
    return out.crossJoin(F.broadcast(before)).select((F.col("n") - F.col("kept")).cast("long").alias("trimmed"), "conflicts")  # one row each


def dare_ties(models: list[DataFrame], base: DataFrame, drop: float = 0.9, density: float = 0.5, seed: int = 42, elect: str = "total", scale: float = 1.0) -> DataFrame:
    """Random dropping and rescaling of the task vectors, then sign election over what is left."""
    rows = dare(stacked([task_vectors(m, base) for m in models]), drop, seed, "model")
    thinned = [_onto(base, rows.filter(F.col("model") == i).select(*KEY, F.col("x").alias("d")), 1.0) for i in range(len(models))]
    return ties(thinned, base, density, elect, scale)


@dataclass(frozen=True)
class SoupConfig:
    method: str = "uniform"
    weights: tuple[float, ...] | None = None
    density: float = 0.5
    elect: str = "total"
    drop: float = 0.9
    seed: int = 42
    scale: float = 1.0

    def __post_init__(self):
        if self.method not in ("uniform", "weighted", "greedy", "ties", "dare_ties", "dare_linear", "task"):
            raise ValueError(f"unknown method {self.method}")
        if not 0 < self.density <= 1 or not 0 <= self.drop <= 1 or self.elect not in ("total", "frequency"):
            raise ValueError("density must be in (0, 1], drop in [0, 1], elect total or frequency")


def soup(models: list[DataFrame], config: SoupConfig = SoupConfig(), base: DataFrame | None = None, score=None) -> DataFrame:
    """Merges models as the configuration says; a single model comes back as it is."""
    if not models:
        raise ValueError("no models")
    if len(models) == 1:
        return models[0].select(*KEY, "x")
    if base is None and config.method in ("ties", "dare_ties", "dare_linear", "task"):
        raise ValueError(f"{config.method} needs a base")
    if config.method == "greedy":
        if score is None:
            raise ValueError("greedy needs a score")
        return greedy_soup(models, score)[1]
    if config.method == "weighted":
        if not config.weights or len(config.weights) != len(models):
            raise ValueError("as many weights as models are needed")
        return weighted_soup(models, list(config.weights))
    if config.method == "ties":
        return ties(models, base, config.density, config.elect, config.scale)
    if config.method == "dare_ties":
        return dare_ties(models, base, config.drop, config.density, config.seed, config.elect, config.scale)
    if config.method == "dare_linear":
        return dare_linear(models, base, config.drop, config.seed)
    return task_arithmetic(models, base, config.scale) if config.method == "task" else weighted_soup(models)


def uniform_soup(models: list[DataFrame]) -> DataFrame:
    return soup(models)


def average(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return interpolate(ours, theirs, 0.5)


def chance(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that only depends on seed and columns, so retried tasks draw the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 31)) / F.lit(float(1 << 31))


def dare(vectors: DataFrame, drop: float, seed: int = 42, *by: str) -> DataFrame:
    """Drops each value with probability `drop` and rescales the rest; with drop 1 all are 0."""
    if drop >= 1:
        return vectors.withColumn("x", F.lit(0.0))
    keep = chance(seed, *by, *KEY) >= drop
    return vectors.withColumn("x", F.when(keep, F.col("x") / (1 - drop)).otherwise(0.0))


def dare_linear(models: list[DataFrame], base: DataFrame, drop: float = 0.9, seed: int = 42) -> DataFrame:
    rows = dare(stacked([task_vectors(m, base) for m in models]), drop, seed, "model")
    return _onto(base, rows.groupBy(*KEY).agg(F.avg("x").alias("d")), 1.0)


def greedy_soup(models: list[DataFrame], score) -> tuple[list[int], DataFrame]:
    """Adds models, best first, while the average's score gets strictly better. `score(model) -> float` runs an aggregate."""
    order = sorted(range(len(models)), key=lambda i: (-score(models[i]), i))
    taken, best = order[:1], score(models[order[0]])
    for i in order[1:]:
        s = score(weighted_soup([models[k] for k in [*taken, i]]))
        if s > best:
            taken, best = [*taken, i], s
    return taken, weighted_soup([models[k] for k in taken])


def _onto(base: DataFrame, deltas: DataFrame, scale: float) -> DataFrame:
    pair = deltas.join(base.select(*KEY, F.col("x").alias("b")), list(KEY), "left")
    return pair.select(*KEY, (F.coalesce("b", F.lit(0.0)) + scale * F.col("d")).alias("x"))
