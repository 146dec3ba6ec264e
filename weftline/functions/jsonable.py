"""JSON text of values that hold NumPy numbers, arrays and types."""

from __future__ import annotations

import json

import numpy as np


def plain(value):
    """A value that the json module knows."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.dtype):
        return value.name
    raise TypeError(f"can't write {type(value).__name__} as JSON")


def dumps(value, **more) -> str:
    return json.dumps(value, default=plain, **more)


def dump(value, file, **more) -> None:
    file.write(dumps(value, **more))
