"""Bounded samples of labelled texts, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out

#: Labelled rows that a classifier is fitted on at most.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, text, label` of up to `rows` labelled rows outside the held-out fold, those with the smallest hash of id and label.

    The side that is broadcast has `rows` rows of three numbers at most, and of an id that is repeated one text is taken
    (that with the smallest hash), so there are `rows` rows at most. Null ids, null labels and null texts are left out.
    """
    usable = labels.filter(~held_out(id_col, 4, 2) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).distinct().withColumn("order", F.xxhash64("id", "label"))
    chosen = chosen.orderBy("order", "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    met = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return met.select("id", "text", "label", "order")


class Isotonic:
    """Non-decreasing map from raw scores to rates: pooled neighbours, straight lines between their middles."""

    def __init__(self, raw: np.ndarray, label: np.ndarray):
        order = np.argsort(raw, kind="stable")
        raw, label = np.asarray(raw, float)[order], np.asarray(label, float)[order]
        blocks: list[list[float]] = []  # rows, labels, sum of raw
        i = 0
        while i < len(raw):
            j = int(np.searchsorted(raw, raw[i], side="right"))  # ties belong together
            blocks.append([j - i, label[i:j].sum(), raw[i:j].sum()])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
            i = j
        self.at = np.array([b[2] / b[0] for b in blocks])
        self.rate = np.array([b[1] / b[0] for b in blocks])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(raw), 0.5)
        return np.clip(np.interp(raw, self.at, self.rate), 0.0, 1.0)
