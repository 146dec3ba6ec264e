"""Corpus preparation: quality filter, near-duplicate removal, secret redaction, source mixing, tokenizing.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last keep the
columns of documents. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import op1_quality, op3_sentencepiece, op5_mixing, op6_secrets, op7_minhash
from weftline.llm.common import materialize, read, small_batches

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows of `docs`, doesn't reject.

    Null and empty texts are scored like any other; repeated rows fare alike; without labels nothing is rejected for its
    text alone (all have the same score); an empty table stays empty; other columns pass through.
    """
    return op1_quality.keep(docs, op1_quality.fit(docs, read(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """`id, text` and `more` alone: `id` is a row's identity, the same for rows of the same doc_id and text; it comes first in the order of doc_id, nulls last."""
    key = F.xxhash64("doc_id", "text")
    return docs.select(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), key.alias("k")).alias("id"), "text", *more)


def _packed(docs: DataFrame) -> DataFrame:
    """`row` (all columns in one) and `k`, so that no column of the documents meets a helper of the same name."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (nulls last; of repeated rows one).

    Documents without words stay, all of them; an empty table stays empty; other columns pass through.
    """
    small_batches(spark)
    found = op7_minhash.group(_keyed(docs), "id")
    kept = found.filter("kept").select(F.col("id.k").alias("k"), (F.col("n_shingles") > 0).alias("once")).distinct()
    rows = _packed(docs).join(kept, "k")
    rows = rows.withColumn("u", F.when(F.col("once"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["k", "u"]).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and `n_chars` (where there is one) counted again; null texts stay null."""
    small_batches(spark)
    out = op6_secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, to the nearest, in the order of their training positions.

    A document without words has no size, so the mix takes none of it; neither does it of documents of which it takes less
    than half. Repeated rows are separate documents; null sources are one source. Rows are range-sorted, so part files and
    rows in them are in training order, which `tokenize` reads back.
    """
    small_batches(spark)
    mixed = op5_mixing.mix(_keyed(docs, "source"), "id")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = mixed.filter("size > 0").withColumn("copies", copies).filter("copies > 0")
    each = mixed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = op5_mixing.position(F.col("before") + F.col("source_size") * F.col("c"), F.col("target"), F.col("slope"))
    each = each.select(F.col("id.k").alias("k"), at.alias("at"))
    return _packed(docs).dropDuplicates(["k"]).join(each, "k").orderBy("at", "k").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (null texts as empty ones), the digest of what they decode to, and `position`.

    `position` puts rows in the order in which the stage before wrote them: part file, then row of the file. Documents that
    aren't read from files have none (null).
    """
    small_batches(spark)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    place = F.when(number != "", F.shiftleft(number.cast("long"), 40) + F.col("_metadata.row_index"))
    try:
        placed = docs.select("doc_id", "text", place.alias("position"))
    except AnalysisException:  # not a scan of files
        placed = docs.select("doc_id", "text", F.lit(None).cast("long").alias("position"))
    placed = placed.select(F.struct("doc_id", "position").alias("doc"), "text")
    encoded = op3_sentencepiece.encode_decode(placed, public_tokenizers.path("piece_bpe_32k.model"), "doc")
    return encoded.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "doc.position")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
