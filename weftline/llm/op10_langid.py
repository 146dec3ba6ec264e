"""Language identification by compression.

Each language has a raw-content zstandard dictionary: whole training texts of that language. A text is cut into windows,
each window is compressed against every language's dictionary, and the language with the smallest total length wins. Ties
go to the language with more training rows, then to the smaller name. Where the best language saves less than MIN_MARGIN
of the next one's bytes the margin is too narrow and the prediction is rejected: `rejected` is true and the score is below
0.5, so that a reader may put the row aside; the best guess itself stays in `lang_pred`.

Fitting takes up to SAMPLE_DOCS distinct training texts of each language (those with the smallest hash), a documented
bound, as whole texts; DICT_BYTES is the room of a dictionary, filled with texts in that order as long as they fit (a text
longer than all the room gives its first stretch of that length). Prediction covers whole texts. Rows with a null text or
without any letter are `und`, with score 0, and count as rejected. Null languages and null ids aren't learned from; without
any training row everything is `und`. Repeated rows get the same answer and very long texts are just more windows. Other
columns than the id, text and language are not carried, so clashing names can't arise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import held_out, read, sample_texts, slices

SAMPLE_DOCS = 192
DICT_BYTES = 49_152
WINDOW = 512
#: Share of bytes that the best language must save over the next.
MIN_MARGIN = 0.01


def compressor(data: bytes, strategy: int, min_match: int, search: int, target: int = 0):
    import zstandard

    content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(strategy=strategy, min_match=min_match, window_log=17, hash_log=15, chain_log=16, search_log=search, target_length=target, write_content_size=0, write_checksum=0, write_dict_id=0)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, bytes]]:
    """(language, training rows, dictionary) by rows, most first. `df` holds training rows only."""
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    texts = sample_texts(known, "lang", "text", {r["lang"]: r["count"] for r in counts}, SAMPLE_DOCS, DICT_BYTES)
    return [(r["lang"], r["count"], _filled(texts.get(r["lang"], []))) for r in counts]


def _filled(texts: list[str]) -> bytes:
    out = b""
    for text in texts:
        raw = text.lower().encode()
        if not out or len(out) + 1 + len(raw) <= DICT_BYTES:
            out += b"\n" + raw[:DICT_BYTES]
    return out


class Identifier:
    def __init__(self, model: list[tuple[str, int, bytes]]):
        self.langs = [lang for lang, _, _ in model]
        rows = sum(n for _, n, _ in model) or 1
        self.prior = [-0.1 * n / rows for _, n, _ in model]
        self.coders = [compressor(data, 6, 4, 4) for _, _, data in model]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (share of bytes that the best language saves over the next)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = text.lower().encode()
        sizes = self.prior.copy()
        for start in range(0, len(raw), WINDOW):
            window = raw[start : start + WINDOW]
            for k, coder in enumerate(self.coders):
                sizes[k] += len(coder.compress(window))
        best = min(range(len(sizes)), key=lambda k: (sizes[k], -self.prior[k], self.langs[k]))
        rest = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = max(0.0, (rest - sizes[best]) / max(rest, 1e-9))
        return self.langs[best], 0.5 * margin / MIN_MARGIN if margin < MIN_MARGIN else min(1.0, 0.5 + 5.0 * (margin - MIN_MARGIN)), margin


def identify(df: DataFrame, model: list[tuple[str, int, bytes]], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row: id, `lang_pred`, `score` (below 0.5: margin under MIN_MARGIN) and `rejected` (margin under `min_margin`)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(model)
        for part in slices(batches):
            found = [own.predict(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] < min_margin for f in found], pa.bool_())],
                names=["id", "lang_pred", "score", "rejected"],
            )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
