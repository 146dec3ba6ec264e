"""Checkpoint policy over a stream of training events, with callbacks; and the training state as a row.

`CheckpointManager` is a foreachBatch sink: each micro-batch of `run, seq, step, epoch, loss` is judged against the state
table that the one before wrote (one row a run), what is to be saved is appended as records, and callbacks hear of them.
Batches are numbered by the stream, so a batch that is delivered again after a failure writes over its own files and is
judged against the same state: records appear once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STATE = "run long, best double, no_improve long, last_seq long"
_RECORDS = "run long, seq long, step long, epoch long, loss double, is_best boolean, no_improve long, stop boolean"


@dataclass
class TrainingState:
    """Where a run is; opaque parts (optimizer, scheduler, random numbers) travel as they are."""

    epoch: int = 0
    step: int = 0
    learning_rate: float | None = None
    loss: float | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    opaque: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TrainingState:
        return cls(**json.loads(text))

    def updated(self, **changes) -> TrainingState:
        """A new state; metrics are merged, the new ones winning."""
        metrics = self.metrics | changes.pop("metrics", {})
        return TrainingState(**(asdict(self) | changes | {"metrics": metrics}))

    def summary(self) -> str:
        parts = [f"epoch {self.epoch}", f"step {self.step}", *([f"loss {self.loss:.4f}"] if self.loss is not None else [])]
        return ", ".join([*parts, *(f"{k} {v:.4f}" for k, v in sorted(self.metrics.items()))])


class CheckpointManager:
    def __init__(self, spark: SparkSession, path: str, every_steps: int = 50, every_epochs: int = 5, threshold: float = 0.5, patience: int = 5):
        self.spark, self.path = spark, path
        self.every_steps, self.every_epochs, self.threshold, self.patience = every_steps, every_epochs, threshold, patience
        self._callbacks: list[Callable[[str, list], None]] = []
        self.failures: list[str] = []

    def register(self, callback: Callable[[str, list], None]) -> None:
        """`callback(event, rows)` for saved, best and stop; the same one once."""
        if callback not in self._callbacks:
            self._callbacks.append(callback)

    def unregister(self, callback) -> None:
        if callback in self._callbacks:
            self._callbacks.remove(callback)

    def clear(self) -> None:
        self._callbacks.clear()

    def callbacks(self) -> list:
        return list(self._callbacks)

    def _call(self, event: str, rows: list) -> None:
        for callback in self._callbacks if rows else ():
            try:
                callback(event, rows)
            except Exception as e:  # a callback must not stop training; what went wrong is kept
                self.failures.append(f"{event}: {type(e).__name__}: {e}")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """Rows of the batches before this one."""
        from weftline.operators.store import ObjectStore

        rows = ObjectStore(self.spark, f"{self.path}/{name}").read()
        return self.spark.createDataFrame([], f"{schema}, batch int") if rows is None else rows.filter(F.col("batch") < before)

    def state(self, before: int = 1 << 30) -> DataFrame:
        rows = self._read("state", _STATE, before)
        newest = rows.groupBy("run").agg(F.max_by(F.struct("best", "no_improve", "last_seq"), "batch").alias("s"))
        return newest.select("run", "s.*")

    def records(self) -> DataFrame:
        return self._read("records", _RECORDS, 1 << 30).drop("batch")

    def judged(self, events: DataFrame, state: DataFrame) -> DataFrame:
        """Each event with `is_best`, `best`, `no_improve`, `stop` and `save`, carrying on from the state."""
        own = Window.partitionBy("run").orderBy("seq")
        rows = events.join(state.withColumnRenamed("best", "held"), "run", "left").filter("last_seq is null or seq > last_seq")
        before = F.least("held", F.min("loss").over(own.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("before", before)
        gain = F.col("before").isNull() | (F.col("loss") < F.col("before") - self.threshold)
        rows = rows.withColumns({"is_best": F.col("before").isNull() | (F.col("loss") < F.col("before")), "island": F.sum(gain.cast("int")).over(own)})
        place = F.row_number().over(Window.partitionBy("run", "island").orderBy("seq"))
        waited = F.when(F.col("island") == 0, F.coalesce("no_improve", F.lit(0)) + place).otherwise(place - 1)
        rows = rows.withColumn("waited", waited).drop("no_improve").withColumnRenamed("waited", "no_improve")
        save = (F.col("step") % self.every_steps == 0) | (F.col("epoch") % self.every_epochs == 0) | F.col("is_best")
        return rows.withColumns({"best": F.least("before", "loss"), "stop": F.col("no_improve") >= self.patience, "save": save})

    def process(self, events: DataFrame, batch: int) -> None:
        """One micro-batch; the sink for `writeStream.foreachBatch`."""
        from weftline.operators.lineage import cut

        rows = cut(self.judged(events, self.state(batch)))
        record = [c.split()[0] for c in _RECORDS.split(", ")]
        saved = rows.filter("save").select(*record)
        saved.write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")
        after = rows.groupBy("run").agg(F.min("best").alias("best"), F.max_by("no_improve", "seq").cast("long").alias("no_improve"), F.max("seq").alias("last_seq"))
        after.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        if self._callbacks:
            self._call("saved", saved.collect())  # what a micro-batch saves, one row a checkpoint
            self._call("best", rows.filter("is_best").select("run", "seq", "loss").collect())
            self._call("stop", rows.filter("stop").groupBy("run").agg(F.min("seq").alias("seq")).collect())

    def start(self, events: DataFrame, checkpoint: str):
        return events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).start()
