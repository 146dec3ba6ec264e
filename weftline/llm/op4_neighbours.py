"""Nearest neighbours by a permutation index.

PIVOTS directions, a bounded sample of the vectors with none near another, order every vector: its permutation of pivots
from nearest to farthest. Candidates are taken relative to their mean, which changes each query's products by a constant
only, so that vectors which share a direction are told apart as well. An inverted file lists, for each pivot, the vectors
that have it among their POSTS nearest. A query reads the lists of its PROBES nearest pivots, ranks each list by footrule
distance (sum of rank differences over all pivots), reranks the best part of it (RERANK / sqrt(rows of the table), all
ties with the last included) by exact inner product in double precision, and the lists' results are merged. Every vector
is in the index, of its copies those that come first among ties; recall against brute force is measured by `recall`.

Lists and their queries are cut into blocks and each two blocks meet in one task, so a pivot with a third of all vectors
is just more tasks. Permutations know directions only, so lists are also cut into bands of nearly equal length (factor
BAND), each ranked and reranked by itself. Vectors of the longest bands are the nearest of many queries whatever their
direction: those of up to LONG of all rows meet every query in full, and those next in length are under more pivots.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; shorter vectors count as
continued with zeros; a query isn't compared with its own row, but with repeated rows; null ids are candidates (last among
ties), never queries; empty tables give empty results. Other columns than id and vector are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, read
from weftline.llm.vectors import directions, matrix, mean, spread_sample, stored

PIVOTS, POOL = 128, 2_048
POSTS, PROBES = 4, 32
#: How far queries are moved by the candidates' mean before they are ranked: nearly all, as what is left of the mean decides
#: between candidates whose lengths along it differ.
QUERY_SHIFT = 0.9
#: A list's reranked share is this over the square root of the table's rows: 45 % of 2,000, 9 % of 50,000, 0.2 % of 10**8.
RERANK = 20.0
BAND, LONG = 1.25, 0.05
#: Postings of bands that, with all longer ones, have up to this share of the rows.
MORE_POSTS = ((0.15, 16), (0.4, 8))
#: In place of a pivot: the list that every query reads in full.
EVERY = -1
LIST_BLOCK, QUERY_BLOCK = 16_384, 4_096


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rank of every pivot for every row (0: nearest)."""
    s = x @ pivots.T
    order = np.argsort(-s, axis=1, kind="stable")
    ranks = np.empty(order.shape, np.uint8)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(s.shape[1], dtype=np.uint8), order.shape), 1)
    return ranks


def footrule(ranks: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sum of rank differences to one query; 16-bit, as PIVOTS * PIVOTS / 2 bounds it."""
    return (np.maximum(ranks, query) - np.minimum(ranks, query)).sum(axis=1, dtype=np.uint16)


def bands(x: np.ndarray) -> np.ndarray:
    """Number of each row's band of lengths; 0 is around length 1."""
    top = np.maximum(np.abs(x).max(axis=1), 1e-300)
    length = np.log(top) + 0.5 * np.log(np.maximum(((x / top[:, None]) ** 2).sum(axis=1), 1e-300))
    return np.floor(length / np.log(BAND) + 0.5).astype(np.int32)


def _posts(table: DataFrame, centre: np.ndarray) -> tuple[dict[int, int], int]:
    """For each band how many lists its vectors are in (0: in the one that every query reads), and the rows of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(bands(matrix(batch.column(0)) - centre))], names=["band"])

    counts = sorted(((r["band"], r["count"]) for r in table.select("vec").mapInArrow(run, "band int").groupBy("band").count().collect()), reverse=True)
    total, so_far, out = sum(n for _, n in counts), 0, {}
    for band, n in counts:
        so_far += n
        out[band] = 0 if so_far <= LONG * total else next((posts for share, posts in MORE_POSTS if so_far <= share * total), POSTS)
    return out, total


def _ranked(table: DataFrame, pivots: np.ndarray, centre: np.ndarray, posts: dict[int, int] | None) -> DataFrame:
    """`row, id, vec, ranks, band, pivot`: every row under its nearest pivots, by its band's `posts`; queries (None) under PROBES and EVERY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(2))
                away = x - centre
                ranks, band = permutations(directions(x - QUERY_SHIFT * centre if posts is None else away), pivots), bands(away)
                if posts is None:
                    near = [[EVERY, *np.flatnonzero(r < PROBES).tolist()] for r in ranks]
                else:
                    near = [np.flatnonzero(r < posts[b]).tolist() or [EVERY] for r, b in zip(ranks, band.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in ranks], pa.binary()), pa.array(band), pa.array(near, pa.list_(pa.int32()))], names=["row", "id", "vec", "ranks", "band", "pivots"])

    kind = table.schema["id"].dataType.simpleString()
    made = table.select("row", "id", "vec").mapInArrow(run, f"row long, id {kind}, vec binary, ranks binary, band int, pivots array<int>")
    return made.withColumn("pivot", F.explode("pivots")).drop("pivots")


def search(table: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`query_row, query, rank, id, score` for stored tables (`row, id, vec`) that share their row numbers."""
    centre = mean(table)
    pivots = spread_sample(table, PIVOTS, POOL, 0.8, centre)
    if not len(pivots):  # all vectors are equal
        pivots = np.ones((1, len(centre)))
    # copies have the same score, so of each vector those that come first among ties are enough; one may be the query itself
    copy = F.row_number().over(Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"), "row"))
    candidates = table.withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy")
    posts, total = _posts(candidates, centre)
    share = min(1.0, RERANK / math.sqrt(max(total, 1)))
    posted = materialize(_ranked(candidates, pivots, centre, posts), "postings")
    asked = materialize(_ranked(queries, pivots, centre, None).drop("band"), "probes")
    sizes = lambda df, by, most, name: df.groupBy(*by).agg(F.ceil(F.count("row") / most).cast("int").alias(name))
    cuts = sizes(posted, ["pivot", "band"], LIST_BLOCK, "lists").join(sizes(asked, ["pivot"], QUERY_BLOCK, "asks"), "pivot")  # PIVOTS + 1 rows a band at most
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    unit_of = lambda a, b: F.concat_ws(":", "pivot", "band", a, b)
    left = posted.join(F.broadcast(cuts), ["pivot", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).withColumn("unit", unit_of(block("lists"), "other"))
    right = asked.join(F.broadcast(cuts), "pivot").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).withColumn("unit", unit_of("other", block("asks")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, ids = a.column("row").to_numpy(), a.column("id")
        n = len(rows)
        out_q, out_c, out_s = [], [], []
        if n and b.num_rows:
            x, width = matrix(a.column("vec")), len(a.column("ranks")[0].as_py())
            ranks = np.frombuffer(b"".join(a.column("ranks").to_pylist()), np.uint8).reshape(n, width)
            most = n if a.column("pivot")[0].as_py() == EVERY else int(math.ceil(share * n))
            for i, (row, vec, own) in enumerate(zip(b.column("row").to_pylist(), matrix(b.column("vec")), b.column("ranks").to_pylist(), strict=True)):
                at = np.arange(n)
                if most < n:
                    away = footrule(ranks, np.frombuffer(own, np.uint8))
                    at = np.flatnonzero(away <= np.partition(away, most - 1)[most - 1])  # ties with the last one stay here, too
                at = at[rows[at] != row]
                score = (x[at] * vec).sum(axis=1)
                if len(at) > k:
                    edge = np.partition(score, len(at) - k)[len(at) - k]
                    best = np.flatnonzero(score >= edge)  # ties with the last one stay: ids decide later
                    at, score = at[best], score[best]
                out_q.append(np.full(len(at), i))
                out_c.append(at)
                out_s.append(score)
        q = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
        c = np.concatenate(out_c) if out_c else np.zeros(0, np.int64)
        s = np.concatenate(out_s) if out_s else np.zeros(0)
        return pa.table([b.column("row").take(pa.array(q)), b.column("id").take(pa.array(q)), a.column("row").take(pa.array(c)), ids.take(pa.array(c)), pa.array(s)], names=["query_row", "query", "row", "id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    met = left.select("unit", "row", "id", "vec", "ranks", "pivot").groupBy("unit").cogroup(right.select("unit", "row", "id", "vec", "ranks").groupBy("unit")).applyInArrow(meet, f"query_row long, query {kind}, row long, id {kind}, score double")
    once = met.groupBy("query_row", "row").agg(F.first("query").alias("query"), F.first("id").alias("id"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_row", "query", "rank", "id", "score")


def neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` nearest of all other rows for each row of `df` whose id (column `id`) meets `is_query`."""
    table = stored(df, id_col, vector_col, "vectors")
    return search(table, table.filter(is_query), k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def recall(df: DataFrame, found: DataFrame, queries: int = 64, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the exact `k` nearest of some queries (smallest id hashes; ids must be unique) that `found` has."""
    table = stored(df, id_col, vector_col, "audit")
    chosen = table.join(found.select(F.col("query_id").alias("id")).distinct(), "id").orderBy(F.xxhash64("id")).limit(queries).collect()
    if not chosen:
        return 1.0
    x = np.frombuffer(b"".join(r["vec"] for r in chosen)).reshape(len(chosen), -1)
    own = np.array([r["row"] for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = x @ matrix(batch.column(2)).T
                rows = batch.column(0).to_numpy()
                s[own[:, None] == rows[None]] = -np.inf
                top = np.argsort(-s, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), top.shape[1])), batch.column(1).take(pa.array(top.ravel())), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["q", "id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    best = table.select("row", "id", "vec").mapInArrow(run, f"q long, id {kind}, score double").filter("score > '-Infinity'")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("place") <= k).collect()
    have = {(r[0], r[1]) for r in found.filter(F.col("query_id").isin([r["id"] for r in chosen])).select("query_id", id_col).collect()}
    return sum((chosen[r["q"]]["id"], r["id"]) in have for r in best) / max(1, len(best))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
