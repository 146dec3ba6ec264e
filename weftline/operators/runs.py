"""Experiment runs, their links to commits, and publishing records, as tables.

`runs(run, status, started, ended)`, `links(run, commit, at)`, `metrics(run, key, value, step)`, `params(run, key, value)`,
`publishes(id, model, registry, ok, at)`. A store of runs only ever appends; queries take the newest row that counts.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import store


def commit_of_run(links: DataFrame, runs: DataFrame) -> DataFrame:
    """`run, commit`: the commit that each wanted run was linked with last."""
    return links.join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))


def runs_of_commit(links: DataFrame, commits: DataFrame) -> DataFrame:
    return links.join(commits.select("commit").distinct(), "commit", "left_semi").select("commit", "run").distinct()


def weights_of_run(links: DataFrame, manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """`run, name, hash` of the commit that each run is linked with; runs without a link have no rows."""
    return commit_of_run(links, runs).join(manifests.select("commit", "name", "hash"), "commit").select("run", "name", "hash")


def unlinked(links: DataFrame, runs: DataFrame) -> DataFrame:
    return runs.select("run").join(links.select("run"), "run", "left_anti")


def run_summary(metrics: DataFrame) -> DataFrame:
    """Per run and key: last value by step, extremes and how many were logged."""
    return metrics.groupBy("run", "key").agg(F.max_by("value", "step").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


def numeric(values: Column) -> Column:
    """Of a map of texts those that are numbers, as doubles; true and false count as 1 and 0."""
    as_number = lambda v: F.when(F.lower(v).isin("true", "false"), (F.lower(v) == "true").cast("double")).otherwise(v.try_cast("double"))
    return F.map_filter(F.transform_values(values, lambda _, v: as_number(v)), lambda _, v: v.isNotNull())


def metric(values: Column, key: str, default: float | None = None) -> Column:
    return F.when(F.map_contains_key(values, key), F.element_at(values, key)).otherwise(F.lit(default))


def tracked(events: DataFrame, every: int, mode: str = "min") -> DataFrame:
    """Callback rules for each event of `run, seq, step, metric`: `best` (strictly better than all before), `due` (every so many steps, once a step), `save`.

    `best_value` is the best so far, this event included; null metrics are never best.
    """
    from pyspark.sql import Window

    if mode not in ("min", "max"):
        raise ValueError(f"unknown mode {mode}")
    own = Window.partitionBy("run").orderBy("seq")
    pick = F.min if mode == "min" else F.max
    before = pick("metric").over(own.rowsBetween(Window.unboundedPreceding, -1))
    better = (F.col("metric") < before) if mode == "min" else (F.col("metric") > before)
    best = F.col("metric").isNotNull() & (before.isNull() | better)
    due = (F.col("step") % every == 0) & (F.col("step") > 0) & F.coalesce(F.lag("step").over(own) != F.col("step"), F.lit(True))
    out = events.withColumns({"best": best, "due": due, "best_value": pick("metric").over(own)})
    return out.withColumn("save", F.col("best") | F.col("due"))


def newest_publish(publishes: DataFrame) -> DataFrame:
    """`model, id, at` of each model's last successful publish."""
    return publishes.filter("ok").groupBy("model").agg(F.max_by("id", F.struct("at", "id")).alias("id"), F.max("at").alias("at"))


def model_card(publishes: DataFrame) -> DataFrame:
    """`id, card`: a short Markdown text for each publish."""
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    return publishes.select("id", F.concat_ws("\n", F.concat(F.lit("# "), "model"), F.lit(""), line("commit", "commit"), line("registry", "registry"), line("tensors", "tensors")).alias("card"))


class RunStore:
    """Appends runs, links and values under one folder."""

    _SCHEMAS = {
        "runs": "run string, status string, started timestamp, ended timestamp",
        "links": "run string, commit string, at timestamp",
        "metrics": "run string, key string, value double, step long",
        "params": "run string, key string, value string",
        "publishes": "id string, model string, commit string, registry string, ok boolean, at timestamp, tensors long",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        rows = store.ObjectStore(self.spark, f"{self.path}/{name}").read()
        return self.spark.createDataFrame([], self._SCHEMAS[name]) if rows is None else rows

    def _append(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, self._SCHEMAS[name]).write.mode("append").parquet(f"{self.path}/{name}")

    def start(self, run: str) -> None:
        self._append("runs", [(run, "running", _now(), None)])

    def end(self, run: str, status: str = "finished") -> None:
        self._append("runs", [(run, status, None, _now())])

    def info(self) -> DataFrame:
        """`run, status, started, ended`: the last status of each run."""
        rows = self.table("runs")
        return rows.groupBy("run").agg(F.max_by("status", F.coalesce("ended", "started")).alias("status"), F.min("started").alias("started"), F.max("ended").alias("ended"))

    def link(self, run: str, commit: str) -> None:
        self._append("links", [(run, commit, _now())])

    def log_metrics(self, run: str, values: dict[str, float], step: int = 0) -> None:
        self._append("metrics", [(run, k, float(v), step) for k, v in values.items()])

    def log_params(self, run: str, values: dict) -> None:
        self._append("params", [(run, k, str(v)) for k, v in values.items()])

    def publish(self, id_: str, model: str, commit: str, registry: str, ok: bool, tensors: int) -> None:
        self._append("publishes", [(id_, model, commit, registry, ok, _now(), tensors)])


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
