import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import jsonable
from weftline.operators.lazy import LazyTensors
from weftline.sources import frameworks


class Linear:
    pass


class Torchlike:
    def __init__(self):
        self.fc = Linear()
        self.p = {"fc.weight": np.ones((2, 3), np.float32), "fc.bias": np.zeros(2, np.float32)}

    def named_parameters(self):
        return self.p.items()

    def load_state_dict(self, state, strict):
        self.p.update(state)


class Variable:
    def __init__(self, name, x, trainable):
        self.name, self.x, self.trainable = name, x, trainable

    def __array__(self, dtype=None, copy=None):
        return self.x

    def assign(self, x):
        self.x = x


def test_models_as_rows_and_back(spark):
    m = Torchlike()
    rows = frameworks.read(spark, m)
    assert {(r["name"], r["layer_type"], tuple(r["shape"])) for r in rows.collect()} == {("fc.weight", "Linear", (2, 3)), ("fc.bias", "Linear", (2,))}
    doubled = rows.withColumn("values", F.transform("values", lambda x: x * 2))
    assert frameworks.write(doubled, m) == [] and (m.p["fc.weight"] == 2).all() and m.p["fc.weight"].dtype == np.float32
    some = doubled.filter("name = 'fc.weight'").unionByName(doubled.filter("name = 'fc.bias'").withColumn("name", F.lit("other")))
    assert frameworks.write(some, m, strict=False) == [("fc.bias", "missing"), ("other", "unexpected")]
    with pytest.raises(KeyError):
        frameworks.write(some, m)

    class Keraslike:
        weights = [Variable("k", np.ones(2), True), Variable("mean", np.zeros(2), False)]

    assert [r["name"] for r in frameworks.read(spark, Keraslike(), trainable=False).collect()] == ["mean"]
    frameworks.write(frameworks.read(spark, {"k": np.array([3.0, 4.0]), "mean": np.zeros(2)}), Keraslike())
    assert Keraslike.weights[0].x.tolist() == [3.0, 4.0]
    with pytest.raises(ImportError):
        frameworks.require("no_such_package_here")
    assert frameworks.unpack_state(frameworks.pack_state(rng=[1, 2])) == {"rng": [1, 2]}


def test_lazy_tensors_within_a_budget(spark):
    rows = spark.createDataFrame([(f"w{i}", i, [0.0] * (i + 1)) for i in range(4)], "name string, grp int, values array<double>")
    lazy = LazyTensors(rows, 40)
    assert "values" not in lazy.metadata().columns and lazy.metadata(F.col("grp") > 9).count() == 0
    for name in ("w0", "w1", "w2"):
        assert lazy.get(name).count() == 1
    assert not lazy.is_loaded("w0") and lazy.is_loaded("w2") and lazy.cached_bytes() <= 40
    lazy.evict("w2")
    assert lazy.stats()["total_bytes"] == 80 and lazy.stats()["loaded"] == 1
    assert [len(p) for p in lazy.stream(size=3)] == [3, 1] and not list(lazy.stream(F.col("grp") > 9))


def test_json_of_numpy_values():
    out = io.StringIO()
    jsonable.dump({"a": np.int64(1), "b": np.arange(2), "c": np.dtype("float32"), "d": np.bool_(True)}, out, sort_keys=True)
    assert json.loads(out.getvalue()) == {"a": 1, "b": [0, 1], "c": "float32", "d": True}
    with pytest.raises(TypeError):
        jsonable.dumps({1, 2})
