"""Commit graph and training history: closures, common ancestors, logs; best-so-far, early stopping, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import cut


#: Rows that are sent to all executors, by way of the driver, to meet a table that stays where it is.
SMALL = 20_000


def _few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """`rows` as a join should take them: sent to the other side if they are few, else sorted and merged. The other side is never sent."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= SMALL else rows.hint("merge")


def _walk(edges: DataFrame, start: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """Breadth-first rounds: `src, node, depth` reachable from `src` (itself at 0); a node seen before isn't expanded again."""
    spark = edges.sparkSession
    edges = cut(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")))
    seen = start.select("src", F.col("src").alias("node"), F.lit(0).alias("depth")).distinct()
    front, depth = seen, 0
    n = known = seen.count()
    while n and (most is None or depth < most):
        depth += 1
        step = edges.join(_few(front, n), F.col("node") == F.col("_from")).select("src", F.col("_to").alias("node")).distinct()
        front = cut(step.join(_few(seen, known), ["src", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not (n := front.count()):
            break
        seen, known = seen.unionByName(front).coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), known + n
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All commits from which each `src` descends, itself left out."""
    return _walk(edges, start, "child", "parent").filter("depth > 0")


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    return _walk(edges, start, "parent", "child").filter("depth > 0")


def common_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, ancestor`: a common ancestor (selves included) that isn't one of another's; the largest id among several."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("src")).distinct()
    up = cut(_walk(edges, ends, "child", "parent").select("src", "node"))
    both = cut(pairs.join(up.select(F.col("src").alias("a"), "node"), "a").join(up.select(F.col("src").alias("b"), "node"), ["b", "node"]))
    above = edges.select("child", "parent").join(_few(both), F.col("node") == F.col("child")).select("a", "b", F.col("parent").alias("node")).distinct()
    # an ancestor of a common ancestor is the parent of one, as common ancestors are closed upwards
    best = both.join(above, ["a", "b", "node"], "left_anti")
    return best.groupBy("a", "b").agg(F.max("node").alias("ancestor"))


def log(edges: DataFrame, tips: DataFrame, most: int = 10) -> DataFrame:
    """The first-parent chain of each tip, `most` commits at most, as `src, node, depth`.

    By doubling: round k knows each commit's ancestor 2**k steps up, and a chain grows to twice its length, so rounds
    grow with the logarithm of the depth.
    """
    jump = cut(edges.filter("place = 0").select(F.col("child").alias("from"), F.col("parent").alias("to")))
    chain = tips.select("src", F.col("src").alias("node"), F.lit(0).alias("depth")).distinct()
    step = 1
    while step < most:
        grown = cut(jump.join(_few(chain), F.col("node") == F.col("from")).select("src", F.col("to").alias("node"), (F.col("depth") + step).alias("depth")).filter(F.col("depth") < most))
        if grown.isEmpty():
            break
        chain = cut(chain.unionByName(grown))
        step *= 2
        if step < most:
            jump = cut(jump.join(jump.select(F.col("from").alias("to"), F.col("to").alias("far")).hint("merge"), "to").select("from", F.col("far").alias("to")))
    return chain


def kinds(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """`commit, is_merge, is_root` by the number of parents."""
    parents = edges.groupBy(F.col("child").alias("commit")).agg(F.count("parent").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return commits.select("commit").join(parents, "commit", "left").select("commit", (n > 1).alias("is_merge"), (n == 0).alias("is_root"))


def path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, step, node`: the commits on a shortest way from ancestor `a` (step 0) down to `b`, the smallest ids among several."""
    up = cut(_walk(edges, pairs.select(F.col("b").alias("src")).distinct(), "child", "parent"))
    known = up.count()
    ends = up.select(F.col("src").alias("b"), F.col("node").alias("a"), F.col("depth").alias("length")).join(_few(pairs), ["a", "b"])
    front = cut(ends.select("a", "b", "length", F.lit(0).alias("step"), F.col("a").alias("node")))
    # each `b` has its own edges: those into what it descends from, with their distance to it
    below = _few(up.select(F.col("src").alias("b"), F.col("node").alias("next"), "depth"), known)
    ways = cut(edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).join(below, "next"))
    out = front
    while n := front.count():
        down = ways.join(_few(front.filter("step < length"), n), ["b", "node"]).filter(F.col("depth") == F.col("length") - F.col("step") - 1)
        front = cut(down.groupBy("a", "b", "length", (F.col("step") + 1).alias("step")).agg(F.min("next").alias("node")))
        out = out.unionByName(front)
    return out.select("a", "b", "step", "node")


def path_length(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps from ancestor `a` down to `b`; no row if there is no way."""
    up = _walk(edges, pairs.select(F.col("b").alias("src")).distinct(), "child", "parent")
    return pairs.join(up.select(F.col("src").alias("b"), F.col("node").alias("a"), "depth"), ["a", "b"])


def _ordered():
    return Window.partitionBy("run").orderBy("seq")


def best_so_far(events: DataFrame) -> DataFrame:
    """`is_best`: the first event, or strictly below all before it."""
    before = F.min("loss").over(_ordered().rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("best_before", before).withColumn("is_best", F.col("best_before").isNull() | (F.col("loss") < F.col("best_before")))


def early_stopping(events: DataFrame, threshold: float = 0.5, patience: int = 5) -> DataFrame:
    """`no_improve`: events since the last gain beyond `threshold` over the best before; `stop` where it reaches `patience`."""
    rows = best_so_far(events)
    gain = F.col("best_before").isNull() | (F.col("loss") < F.col("best_before") - threshold)
    rows = rows.withColumn("island", F.sum(gain.cast("int")).over(_ordered()))
    rows = rows.withColumn("no_improve", F.row_number().over(Window.partitionBy("run", "island").orderBy("seq")) - 1)
    return rows.withColumn("stop", F.col("no_improve") >= patience)


def should_save(events: DataFrame, every_steps: int = 50, every_epochs: int = 5) -> DataFrame:
    rows = best_so_far(events)
    return rows.withColumn("save", (F.col("step") % every_steps == 0) | (F.col("epoch") % every_epochs == 0) | F.col("is_best"))


def retained(events: DataFrame, last: int = 3, best: int = 2, every_epochs: int = 10) -> DataFrame:
    """Checkpoints that cleaning keeps: the last ones, the best of those that were best, round epochs, and the best of all."""
    rows = best_so_far(events)
    newest = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("seq")))
    finest = F.row_number().over(Window.partitionBy("run", "is_best").orderBy("loss", "seq"))
    top = F.row_number().over(Window.partitionBy("run").orderBy("loss", "seq"))
    rows = rows.withColumns({"newest": newest, "finest": finest, "top": top})
    return rows.filter((F.col("newest") <= last) | (F.col("is_best") & (F.col("finest") <= best)) | (F.col("epoch") % every_epochs == 0) | (F.col("top") == 1))


def recorded(events: DataFrame, every_steps: int = 50, every_epochs: int = 5) -> DataFrame:
    """Events that are saved, with whether each is the best so far when it is saved: `run, seq, step, epoch, loss, is_best, best`."""
    rows = should_save(events, every_steps, every_epochs).withColumn("best", F.min("loss").over(_ordered()))
    return rows.filter("save").select("run", "seq", "step", "epoch", "loss", "is_best", "best")


def listed(records: DataFrame, only_best: bool = False, metrics: bool = True) -> DataFrame:
    rows = records.filter("is_best") if only_best else records
    return rows if metrics else rows.drop("loss", "best")


def chosen(records: DataFrame, wanted: DataFrame | None = None, best: bool = False) -> DataFrame:
    """One record for each run: the best one (`best`), else the wanted `run, seq`, else the last."""
    if best:
        return records.groupBy("run").agg(F.min_by("seq", F.struct("loss", "seq")).alias("seq")).join(records, ["run", "seq"])
    last = records.groupBy("run").agg(F.max("seq").alias("last"))
    if wanted is not None:
        last = last.join(wanted.select("run", F.col("seq").alias("asked")), "run", "left").select("run", F.coalesce("asked", "last").alias("last"))
    return last.withColumnRenamed("last", "seq").join(records, ["run", "seq"])


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("run").agg(F.max("seq").alias("seq"), F.max_by("loss", "seq").alias("loss"))
