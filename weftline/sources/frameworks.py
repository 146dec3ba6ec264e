"""Tensors of framework models as rows and back, without importing a framework: anything that names its parameters will do.

PyTorch style: `named_parameters()` and `load_state_dict`; Keras style: `weights` with `name`, `trainable` and `assign`.
Optimizer, scheduler and random-number states are opaque and travel as pickled bytes in one column.
"""

from __future__ import annotations

import importlib.util
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.operators import store

SCHEMA = "name string, layer_type string, dtype string, shape array<int>, trainable boolean, values array<double>"


def require(package: str) -> None:
    """Raises ImportError with what to install if an optional package is missing."""
    if importlib.util.find_spec(package) is None:
        raise ImportError(f"this needs the optional package {package}")


def _array(x) -> np.ndarray:
    for name in ("detach", "cpu", "numpy"):
        x = getattr(x, name)() if hasattr(x, name) else x
    return np.asarray(x)


def _layer(model, name: str) -> str | None:
    """Class of the module that holds a dotted parameter name."""
    at = model
    for part in name.split(".")[:-1]:
        at = getattr(at, part, None)
        if at is None:
            return None
    return type(at).__name__


def _items(model) -> Iterator[tuple]:
    if hasattr(model, "named_parameters"):
        for name, p in model.named_parameters():
            yield name, _layer(model, name), _array(p), bool(getattr(p, "requires_grad", True))
    elif hasattr(model, "weights"):
        for w in model.weights:
            yield w.name, None, _array(w), bool(getattr(w, "trainable", True))
    elif hasattr(model, "items"):
        for name, x in model.items():
            yield name, None, _array(x), True
    else:
        raise TypeError("the model names no parameters")


def read(spark: SparkSession, model, trainable: bool | None = None) -> DataFrame:
    """One row for each parameter; only trainable or only other ones if asked for."""
    rows = [(n, t, x.dtype.name, list(x.shape), k, x.astype(float).ravel().tolist()) for n, t, x, k in _items(model) if trainable is None or k == trainable]
    return spark.createDataFrame(rows, SCHEMA)


def write(rows: DataFrame, model, strict: bool = True, convert=np.asarray) -> list[tuple[str, str]]:
    """Loads rows into a model and returns what didn't fit: (name, missing or unexpected).

    With `strict` that raises instead. Parameters without a row, or with one of another shape, keep their values.
    `convert` makes the framework's tensor of an array.
    """
    own = {n: x for n, _, x, _ in _items(model)}
    wanted = rows.sparkSession.createDataFrame([(n,) for n in own], "name string")
    problems = sorted((r["name"], r["problem"]) for r in store.key_check(wanted, rows).collect())
    if strict and problems:
        raise KeyError(f"parameters that don't fit: {problems}")
    loaded = {}
    for r in rows.select("name", "values").toLocalIterator():
        x = own.get(r["name"])
        if x is not None and x.size == len(r["values"]):
            loaded[r["name"]] = convert(np.asarray(r["values"], x.dtype).reshape(x.shape))
    if hasattr(model, "load_state_dict"):
        model.load_state_dict(loaded, strict=False)
    elif hasattr(model, "weights"):
        for w in model.weights:
            if w.name in loaded:
                w.assign(loaded[w.name])
    else:
        model.update(loaded)
    return problems


def pack_state(**parts) -> bytes:
    """Optimizer, scheduler and random-number states as bytes, each as its own `state_dict()` where it has one."""
    return pickle.dumps({k: p.state_dict() if hasattr(p, "state_dict") else p for k, p in parts.items()})


def unpack_state(data: bytes) -> dict:
    """What `pack_state` packed; only for bytes that this repository wrote, as unpickling runs code."""
    return pickle.loads(data)
