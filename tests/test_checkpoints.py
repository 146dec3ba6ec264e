import numpy as np

from weftline.operators import history
from weftline.streaming.checkpoints import CheckpointManager, TrainingState


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema = "run long, seq long, step long, epoch long, loss double"
    rows = [(r, s, s * 10, s // 8, float(rng.normal())) for r in range(3) for s in range(1, 31)]
    for part in range(3):
        spark.createDataFrame([x for x in rows if (x[1] - 1) // 10 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    manager, heard = CheckpointManager(spark, str(tmp_path / "m")), []
    note = lambda event, found: heard.append((event, len(found)))
    manager.register(note)
    manager.register(note)
    manager.register(lambda event, found: 1 / 0)
    assert len(manager.callbacks()) == 2
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = manager.start(stream, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    events = spark.createDataFrame(rows, schema)
    want = {(r["run"], r["seq"], r["is_best"]) for r in history.recorded(events).collect()}
    got = manager.records().collect()
    assert {(r["run"], r["seq"], r["is_best"]) for r in got} == want and len(got) == len(want)
    stops = {(r["run"], r["seq"]): (r["no_improve"], r["stop"]) for r in history.early_stopping(events).collect()}
    assert all(stops[r["run"], r["seq"]] == (r["no_improve"], r["stop"]) for r in got)
    assert {r["run"]: r["best"] for r in manager.state().collect()} == {k: min(x[4] for x in rows if x[0] == k) for k in range(3)}
    assert {e for e, _ in heard} >= {"saved", "best"} and manager.failures
    last = spark.createDataFrame([x for x in rows if (x[1] - 1) // 10 == 2], schema)
    manager.process(last, 2)  # delivered again
    assert manager.records().count() == len(want)
    manager.unregister(note)
    manager.clear()
    assert manager.callbacks() == []


def test_training_state_round_trip():
    s = TrainingState(2, 10, 0.1, 0.5, {"acc": 0.9}, {"rng": [1, 2]})
    assert TrainingState.from_json(s.to_json()) == s
    t = s.updated(step=11, metrics={"f1": 0.8})
    assert t.metrics == {"acc": 0.9, "f1": 0.8} and s.step == 10 and t.summary() == "epoch 2, step 11, loss 0.5000, acc 0.9000, f1 0.8000"
