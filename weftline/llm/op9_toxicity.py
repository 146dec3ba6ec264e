"""Toxicity by compression distance.

Two zstandard raw-content dictionaries are trained on labelled texts: one for toxic, one for ordinary text. Dictionaries
of whole texts can't tell the classes apart where toxic passages are a few words in long ordinary ones: nearly all bytes
that one of them saves are chance matches of ordinary words (README has figures). So both hold the same stretch of
ordinary prose, and before it what sets their own class apart: word beginnings whose document frequencies differ beyond
chance, groups of copies counting once. A window is one word between two fixed stretches of that prose (the compressor
finds no match in the last bytes of its input, and short inputs alone would stay uncompressed); it is compressed with both
dictionaries, and the difference of the two lengths is its saving. Windows recur, so each worker keeps their savings in a
bounded cache. On labelled rows that the dictionaries haven't seen, savings become evidence (how much more often windows
of toxic texts save that much), with a threshold below which a window counts for nothing; a text's raw score is the sum of
its windows' evidence, and isotonic calibration turns it into a rate, whose 0.3 is the threshold of texts.

Training takes a bounded sample of labelled rows (`fit.SAMPLE_ROWS`); scoring covers every window of every text. Defined
results: null, empty and blank texts have raw score 0; without labelled rows of both classes every score is 0; repeated
rows get the same score; ties of raw scores have one rate; very long texts are scored whole; a null id is held out; an
empty table gives an empty result. Other columns than id and text are not carried, so clashing names can't arise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import held_out, read
from weftline.llm.fit import SAMPLE_ROWS, Isotonic, labelled_sample
from weftline.llm.words import LOWER, Words, pieces, shingles

#: Least and most bytes that a window's saving counts as.
SAVED = (-16, 32)
#: log of how many times more of the toxic texts' windows must save that much, for a saving to count.
LEAST_EVIDENCE = 3.0
#: Stands before each word in windows and dictionaries; long, so that words that begin as a dictionary's do save more than
#: words that hold the same letters inside.
GAP = b"   "
#: Bytes of prose in both dictionaries.
PROSE_BYTES = 12_288
#: Windows that a worker's cache holds; beyond them it starts anew.
CACHE_WORDS = 1_000_000
BEGIN = range(4, 13)
LEAST_DOCS = 3
#: Tasks that the bounded sample is spread over.
PARTS = 12
#: A word beginning is kept if its gain (binomial log likelihood ratio over groups of copies) is above what chance gives one
#: of some 100,000.
LEAST_GAIN = 13.0
THRESHOLD = 0.3


def beginnings(column: pa.Array) -> Iterator[set[bytes]]:
    """For each text the distinct beginnings, BEGIN bytes long, of its lower-cased words (whole shorter words are left out)."""
    words = Words(column, hashes=False)
    low = LOWER[words.raw].tobytes()
    for i in range(len(column)):
        own = {low[a:b] for a, b in zip(words.start[words.first[i] : words.first[i + 1]].tolist(), words.stop[words.first[i] : words.first[i + 1]].tolist(), strict=True)}
        yield {w[:n] for w in own for n in BEGIN if n <= len(w)}


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One row of each label and group of copies; texts whose smallest shingle hashes are equal count as copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            hashes, first = shingles(Words(part.column(0)))
            has = np.flatnonzero(np.diff(first))
            low = np.zeros(part.num_rows, np.uint64)
            if len(has):
                low[has] = np.minimum.reduceat(hashes, first[:-1][has])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low.view(np.int64))], names=["text", "label", "copies"])

    return sample.select("text", "label").mapInArrow(run, "text string, label int, copies long").dropDuplicates(["copies", "label"]).drop("copies")


def _contrast(sample: DataFrame, rows: dict[int, int]) -> dict[int, bytes]:
    """For toxic texts (1) all word beginnings with enough gain in document frequency, best last; for ordinary ones (0) as many bytes of theirs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for part in pieces(batches, 0):
            for label, own in zip(part.column(1).to_pylist(), beginnings(part.column(0)), strict=True):
                found[int(label == 1)].update(own)
        grams = list(found[0].keys() | found[1].keys())
        for at in range(0, len(grams), 50_000):
            some = grams[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([found[k][g] for g in some], pa.int64()) for k in (0, 1))], names=["gram", "n0", "n1"])

    totals = sample.select("text", "label").mapInArrow(count, "gram binary, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).coalesce(PARTS).persist()
    share = rows[1] / (rows[0] + rows[1])
    seen, toxic = F.col("n0") + F.col("n1"), F.col("n1")
    part = lambda n, rate: F.when(n > 0, n * F.log(n / (seen * rate))).otherwise(0.0)
    gain = part(toxic, share) + part(F.col("n0"), 1 - share)
    best = totals.filter(toxic > share * seen).withColumn("gain", gain).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), F.desc(F.length("gram")), "gram").collect()
    chosen: list[tuple[bytes, int]] = []
    for r in best:
        gram = bytes(r["gram"])
        if not any(gram.startswith(c) or c.startswith(gram) and n == r["n1"] for c, n in chosen):
            chosen.append((gram, r["n1"]))
    out = {1: GAP.join([b"", *(c for c, _ in reversed(chosen)), b""])}
    # as many bytes of what ordinary texts have most of: chance matches then weigh the same on both sides
    usual = totals.filter((toxic <= share * seen) & (F.col("n0") >= LEAST_DOCS)).orderBy(F.desc(F.col("n0") * F.log(F.col("n0") / (toxic + 0.5))), F.desc(F.length("gram")), "gram").limit(max(64, len(out[1])))
    picked: list[bytes] = []
    size = 0
    for r in usual.collect():
        gram = bytes(r["gram"])
        if size < len(out[1]) and not any(gram.startswith(c) or c.startswith(gram) for c in picked):
            picked.append(gram)
            size += len(gram) + 1
    out[0] = GAP.join([b"", *reversed(picked), b""])
    totals.unpersist()
    return out


class Model:
    """Both dictionaries and the calibration."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", prose: bytes = b""):
        wide = len(toxic)
        self.data = [prose + x[-wide:].rjust(wide, b" ") + prose[:64] for x in (ordinary, toxic)]  # the last bytes are never matched
        self.lead, self.tail = prose[1000:1020] + GAP, b" " + prose[1020:1044]
        self.known = bool(toxic.strip())
        self.evidence = np.zeros(SAVED[1] - SAVED[0] + 1)
        self.calibrate = Isotonic(np.zeros(0), np.zeros(0))
        self._coders, self._saved = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_coders": None, "_saved": {}}

    def coders(self):
        if self._coders is None:
            import zstandard

            self._coders = []
            for data in self.data:
                content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters(strategy=7, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=4, write_content_size=0, write_checksum=0, write_dict_id=0)
                content.precompute_compress(compression_params=params)
                self._coders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=content))
        return self._coders

    def windows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of every window of every text: the text's row, and the bytes that the toxic dictionary saves (signed, within SAVED)."""
        words = Words(column)
        owner = np.repeat(np.arange(len(column)), np.diff(words.first))
        if not self.known or not len(words):
            return owner[:0], np.zeros(0, np.int64)
        kinds, at, kind = np.unique(words.hash, return_index=True, return_inverse=True)
        known = self._saved
        if len(known) > CACHE_WORDS:
            known.clear()
        low = LOWER[words.raw].tobytes()
        ordinary, toxic = (c.compress for c in self.coders())
        saved = np.empty(len(kinds), np.int64)
        for i, (h, a, b) in enumerate(zip(kinds.tolist(), words.start[at].tolist(), words.stop[at].tolist(), strict=True)):
            gain = known.get(h)
            if gain is None:
                window = self.lead + low[a:b] + self.tail
                gain = known[h] = len(ordinary(window)) - len(toxic(window))
            saved[i] = gain
        return owner, np.clip(saved, SAVED[0], SAVED[1])[kind]

    def weigh(self, ordinary: np.ndarray, toxic: np.ndarray) -> None:
        """Evidence of a saving from how many windows of both classes' texts save that much at least; too little counts as none."""
        tail = lambda n: (n[::-1].cumsum()[::-1] + 0.5) / (n.sum() + 1.0)
        found = np.log(tail(toxic) / tail(ordinary))
        found[: 1 - SAVED[0]] = 0.0
        self.evidence = np.where(found >= LEAST_EVIDENCE, found, 0.0)

    def raw(self, column: pa.Array) -> np.ndarray:
        """Sum of the evidence of each text's windows."""
        owner, saved = self.windows(column)
        return np.bincount(owner, self.evidence[saved - SAVED[0]], len(column)) if len(owner) else np.zeros(len(column))

    def score(self, column: pa.Array) -> np.ndarray:
        return self.calibrate(self.raw(column)) if self.known else np.zeros(len(column))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col).repartition(PARTS, "order").persist()
    seen = sample.filter(F.pmod("order", F.lit(4)) != 0)
    seen = _one_of_copies(seen).coalesce(PARTS).persist()
    counts = {r["label"]: r["n"] for r in seen.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("label").alias("n")).collect()}
    if len(counts) < 2:
        sample.unpersist()
        seen.unpersist()
        return Model()
    contrast = _contrast(seen, counts)
    middle = F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - 96), F.lit(192))
    grams = contrast[1].split()
    found = [r["t"].lower().encode() for r in seen.filter("label = 0").orderBy(F.xxhash64("text")).limit(4 * PROSE_BYTES // 128).select(middle.alias("t")).collect()]
    prose = [t for t in found if not any(g in t for g in grams)]  # else ordinary text would save on them as well
    model = Model(contrast[0], contrast[1], b" ".join(prose)[:PROSE_BYTES])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SAVED[1] - SAVED[0] + 1), np.int64)
        for part in pieces(batches, 0):
            owner, saved = model.windows(part.column(0))
            np.add.at(total, ((part.column(1).to_numpy() == 1).astype(int)[owner], saved - SAVED[0]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(part.column(0))), part.column(1)], names=["raw", "label"])

    fresh = _one_of_copies(sample.filter(F.pmod("order", F.lit(4)) == 0))
    totals = sum((np.frombuffer(r["total"], np.int64).reshape(2, -1) for r in fresh.mapInArrow(tally, "total binary").collect()), np.zeros((2, SAVED[1] - SAVED[0] + 1), np.int64))
    model.weigh(totals[0], totals[1])
    got = fresh.mapInArrow(run, "raw double, label int").collect()
    sample.unpersist()
    seen.unpersist()
    model.calibrate = Isotonic(np.array([r["raw"] for r in got]), np.array([r["label"] for r in got]))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and `score`."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], names=["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
