"""Tensors on demand: metadata first, values when asked for, within a budget of cached bytes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LazyTensors:
    """Over `name, values` and other columns. `get` persists named subsets on the executors; the least recently used go when the budget is exceeded."""

    def __init__(self, tensors: DataFrame, budget: int, bytes_each: int = 8):
        self.tensors, self.budget, self.bytes_each = tensors, budget, bytes_each
        self._held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def metadata(self, condition: Column | None = None) -> DataFrame:
        """All columns but the values, and each tensor's bytes; a condition that nothing meets gives nothing."""
        rows = self.tensors if condition is None else self.tensors.filter(condition)
        return rows.select(*(c for c in rows.columns if c != "values"), (F.size("values") * self.bytes_each).cast("long").alias("nbytes"))

    def get(self, name: str) -> DataFrame:
        if name in self._held:
            self._held.move_to_end(name)
            return self._held[name][0]
        rows = self.tensors.filter(F.col("name") == name).persist(StorageLevel.MEMORY_AND_DISK)
        size = rows.agg(F.coalesce(F.sum(F.size("values") * self.bytes_each), F.lit(0)).alias("n")).first()["n"]
        self._held[name] = (rows, size)
        while len(self._held) > 1 and self.cached_bytes() > self.budget:
            self.evict(next(iter(self._held)))
        return rows

    def evict(self, name: str) -> None:
        if name in self._held:
            self._held.pop(name)[0].unpersist()

    def is_loaded(self, name: str) -> bool:
        return name in self._held

    def cached_bytes(self) -> int:
        return sum(n for _, n in self._held.values())

    def stats(self) -> dict[str, float]:
        row = self.metadata().agg(F.count(F.lit(1)).alias("tensors"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("total")).first()
        return {"tensors": row["tensors"], "loaded": len(self._held), "total_bytes": row["total"], "cached_bytes": self.cached_bytes(), "used": self.cached_bytes() / self.budget if self.budget else 0.0}

    def stream(self, condition: Column | None = None, size: int = 1) -> Iterator[list]:
        """Rows that meet the condition, `size` at a time, one partition in the driver at once."""
        rows = self.tensors if condition is None else self.tensors.filter(condition)
        part: list = []
        for row in rows.toLocalIterator():
            part.append(row)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part
