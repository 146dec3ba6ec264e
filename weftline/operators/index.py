"""Fingerprint and hyperplane indexes over tensors as tables: an index is its rows, so inserting is a union and removing an anti join.

A fingerprint table has `id, dim, fp` (array of longs, one per 64 bits); a bucket table has `id, dim, table, slot`. Lengths never
meet: `dim` is part of every key, so one table serves tensors of many shapes. Putting an id in again replaces its rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.dedup import by_length, planes
from weftline.operators.lineage import cut

#: A scan's distinct fingerprints and asked ones that meet in a task, bits of a part's key, and pairs compared at once.
BLOCK, CHUNK, PART_BITS, AT_ONCE = 1 << 18, 1 << 17, 20, 1 << 21


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as words of 64 bits: bit i is bit i % 64 of word i // 64."""
    words = -(-bits.shape[1] // 64)
    padded = np.zeros((len(bits), words * 64), np.uint64)
    padded[:, : bits.shape[1]] = bits
    return (padded.reshape(len(bits), words, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def unpacked(words: np.ndarray, bits: int) -> np.ndarray:
    """The 0/1 rows that `packed` made."""
    return ((words.view(np.uint64)[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(words), -1)[:, :bits].astype(np.uint8)


def fingerprints(tensors: DataFrame, bits: int = 128, seed: int = 42, id_col: str = "name", values_col: str = "values") -> DataFrame:
    """`id, dim, fp`: signs of `bits` seeded projections, one matrix product for all rows of a length in a batch."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(by_length(values, lambda x: packed((x @ planes(x.shape[1], bits, seed).T > 0).astype(np.uint64)) if x.shape[1] else packed(np.zeros((len(x), bits), np.uint64))))

    return tensors.select(F.col(id_col).alias("id"), F.size(values_col).alias("dim"), project(F.col(values_col)).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; null if they have different numbers of words."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits)


def alike(a: Column, b: Column, bits: int, share: float | None = None, default: float = 0.1) -> Column:
    """At most int(bits * share) bits differ; a share of 0 is taken as 0."""
    return distance(a, b) <= int(bits * (default if share is None else share))


def inserted(index: DataFrame, rows: DataFrame) -> DataFrame:
    return removed(index, rows).unionByName(rows.select(*index.columns))


def removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def contains(index: DataFrame, ids: DataFrame) -> DataFrame:
    """`id, found` of each wanted id."""
    have = index.select("id").distinct().withColumn("found", F.lit(True))
    return ids.select("id").distinct().join(have, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def cleared(index: DataFrame) -> DataFrame:
    return index.limit(0)


def _parts(free: int, most: int, rows: int) -> list[tuple[int, int]]:
    """`bits, errors` of parts of which one differs in no more than its errors if all differ in `most`; none if comparing all is cheaper.

    Errors and parts number `most` + 1 together. Looked-up keys and the rows that chance puts under them are what it costs.
    """
    best, least = [], rows / 8
    for n in range(1, min(most + 1, free) + 1):
        spare = most + 1 - n
        parts = [(min(PART_BITS, free // n + (i < free % n)), spare // n + (i < spare % n)) for i in range(n)]
        cost = sum(sum(math.comb(b, k) for k in range(e + 1)) * (1 + rows / 2**b) for b, e in parts)
        if cost < least:
            best, least = parts, cost
    return best


def _keys(words: np.ndarray, at: list[int]) -> np.ndarray:
    """The bits `at` of each row as a number."""
    out = np.zeros(len(words), np.int64)
    for k, i in enumerate(at):
        out |= (words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64) << k
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((np.bitwise_count(a[..., w] ^ b[..., w]).astype(np.int32) for w in range(a.shape[-1])), np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int32))


def within(x: np.ndarray, q: np.ndarray, most: int, nearest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of `q`, row of `x` and distance of all pairs of fingerprints that differ in `most` bits at most, each pair once.

    `x` has each fingerprint once. With `nearest` only so many of a row of `q`, and those as near as the last of them.
    """
    varies = np.bitwise_or.reduce(x ^ x[:1], axis=0) if len(x) else np.zeros(x.shape[1], np.uint64)
    free = [i for i in range(64 * x.shape[1]) if int(varies[i // 64]) >> i % 64 & 1]
    tables = []
    for n, (bits, errors) in enumerate(parts := _parts(len(free), most, len(x))):
        at = free[n :: len(parts)][:bits]
        keys = _keys(x, at)
        order = np.argsort(keys, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(keys, minlength=1 << bits)))
        flips = np.array([sum(1 << i for i in some) for k in range(errors + 1) for some in itertools.combinations(range(bits), k)], np.int64)
        tables.append((_keys(q, at), flips, starts, order, x[order]))
    step = max(1, AT_ONCE // (4 * sum(len(t[1]) for t in tables))) if tables else max(1, AT_ONCE // max(1, len(x)))
    for first in range(0, len(q), step):
        own = q[first : first + step]
        probes = [(keys[first : first + step, None] ^ flips).ravel() for keys, flips, *_ in tables]
        counts = [starts[p + 1] - starts[p] for p, (_, _, starts, *_) in zip(probes, tables, strict=True)]
        found = [np.zeros(0, np.int64)]
        if tables and sum(int(c.sum()) for c in counts) < len(own) * len(x) / 4:
            for p, count, (_, flips, starts, order, ordered) in zip(probes, counts, tables, strict=True):
                some = np.flatnonzero(count)
                ends = np.cumsum(count[some])
                for lo, hi in _pieces(ends):
                    n = count[some[lo:hi]]
                    at = np.repeat(starts[p[some[lo:hi]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    row = np.repeat(some[lo:hi] // len(flips), n)
                    near = _differing(ordered[at], own[row]) <= most
                    found.append(row[near] * len(x) + order[at[near]])
        else:
            for at in range(0, len(own), every := max(1, AT_ONCE // max(1, len(x)))):
                i, j = np.nonzero(_differing(own[at : at + every, None], x[None]) <= most)
                found.append((i + at) * len(x) + j)
        row, col = np.divmod(np.unique(np.concatenate(found)), max(1, len(x)))
        bits = _differing(own[row], x[col])
        if nearest is not None:
            by = np.lexsort((bits, row))
            row, col, bits = row[by], col[by], bits[by]
            last = np.searchsorted(row, row) + nearest - 1  # the place of the last one that counts, by query
            limit = np.where(last < np.searchsorted(row, row, "right"), bits[np.minimum(last, len(row) - 1)], most) if len(row) else bits
            row, col, bits = row[bits <= limit], col[bits <= limit], bits[bits <= limit]
        yield row + first, col, bits


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of counts with these running totals that come to AT_ONCE and one more at most."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def _near(kinds: DataFrame, asked: DataFrame, most: int, nearest: int | None) -> DataFrame:
    """`dim, qfp, fp, distance` of distinct `dim, fp` on both sides: blocks of one meet chunks of the other, each two in one task."""
    dim = kinds.schema["dim"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        fp = table.column("fp").combine_chunks()
        words = fp.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(table.num_rows, -1) if len(fp.flatten()) else np.zeros((table.num_rows, 0), np.uint64)
        side = table.column("side").to_numpy()
        x, q = words[side == 0], words[side == 1]
        as_lists = lambda w: pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel().view(np.int64)))
        for row, col, bits in within(x, q, most, nearest):
            for at in range(0, len(row), 1 << 16):
                i, j = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([table.column("dim")[:1].combine_chunks().take(pa.array(np.zeros(len(i), np.int64))), as_lists(q[i]), as_lists(x[j]), pa.array(bits[at : at + (1 << 16)], pa.int32())], names=["dim", "qfp", "fp", "distance"])

    count = lambda df, size, name: df.groupBy("dim", F.size("fp").alias("words")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cuts = cut(count(kinds, BLOCK, "blocks").join(count(asked, CHUNK, "chunks"), ["dim", "words"]))  # a row for each length
    tasks = cuts.agg(F.sum(F.col("blocks").cast("long") * F.col("chunks"))).first()[0] or 1
    part = lambda df, side, own, other: (
        df.withColumn("words", F.size("fp")).join(F.broadcast(cuts), ["dim", "words"])
        .withColumn(own, F.pmod(F.xxhash64("fp", F.lit(side)), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        .select(F.concat_ws(":", "dim", "words", "block", "chunk").alias("task"), F.lit(side).alias("side"), "dim", "fp")
    )
    each = part(kinds, 0, "block", "chunk").unionByName(part(asked, 1, "chunk", "block"))
    return each.repartition(int(min(1000, 4 * tasks)), "task").groupBy("task").applyInArrow(meet, f"dim {dim}, qfp array<bigint>, fp array<bigint>, distance int")


def scan(index: DataFrame, queries: DataFrame, most: int, limit: int | None = None, keep_self: bool = False) -> DataFrame:
    """`query, id, distance`: for stated query rows, all indexed fingerprints of their length within `most` bits, nearest first.

    Distinct fingerprints meet distinct asked ones, by parts of their bits where that is cheaper than comparing all (`within`);
    ids come in afterwards. With a limit a fingerprint's first ids and an asked one's first rows are enough: one more than
    the limit, as a query may meet itself.
    """
    whole = lambda df: df.filter(F.forall("fp", lambda w: w.isNotNull()))  # noqa: E731  others have no distance
    rows, asked = whole(index).select("dim", "fp", "id"), whole(queries).select(F.col("id").alias("query"), "dim", F.col("fp").alias("qfp"))
    wanted = cut(asked.select("dim", F.col("qfp").alias("fp")).distinct())
    kinds = cut(rows.select("dim", "fp").join(wanted.select("dim").distinct(), "dim", "left_semi").distinct())
    near = _near(kinds, wanted, most, None if limit is None else limit + 1)
    if limit is not None:
        first = F.row_number().over(Window.partitionBy("dim", "fp").orderBy("id"))
        rows = rows.filter("id is not null").distinct().withColumn("place", first).filter(F.col("place") <= limit + 1).drop("place")
    near = near.join(rows, ["dim", "fp"]).select("dim", "qfp", "id", "distance")
    if limit is not None:
        first = F.row_number().over(Window.partitionBy("dim", "qfp").orderBy("distance", "id"))
        near = near.withColumn("place", first).filter(F.col("place") <= limit + 1).drop("place")
    found = near.join(asked, ["dim", "qfp"]).select("query", "id", "distance")
    if not keep_self:
        found = found.filter(~F.col("id").eqNullSafe(F.col("query")))
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def fingerprint_stats(index: DataFrame) -> DataFrame:
    """Per length: vectors, distinct fingerprints and vectors per fingerprint (0 for none)."""
    kinds = index.groupBy("dim", "fp").agg(F.count("id").alias("n"))
    out = kinds.groupBy("dim").agg(F.sum("n").cast("long").alias("vectors"), F.count("n").alias("fingerprints"))
    return out.withColumn("mean", F.col("vectors") / F.col("fingerprints"))


def slots(tensors: DataFrame, tables: int = 8, planes_each: int = 8, seed: int = 42, id_col: str = "name", values_col: str = "values") -> DataFrame:
    """`id, dim, table, slot` of a hyperplane index: in each table the signs against its planes, first plane highest."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = 1 << np.arange(planes_each - 1, -1, -1)
        for values in batches:
            yield pd.Series(by_length(values, lambda x: ((x @ planes(x.shape[1], tables * planes_each, seed).T > 0).reshape(len(x), tables, planes_each) * weight).sum(axis=2)))

    placed = tensors.filter(F.size(values_col) > 0).select(F.col(id_col).alias("id"), F.size(values_col).alias("dim"), place(F.col(values_col)).alias("s"))
    return placed.select("id", "dim", F.posexplode("s").alias("table", "slot"))


def bucket_candidates(index: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """`query, id, tables`: ids that share buckets with a stated query row, and how many, most shared first."""
    met = queries.select(F.col("id").alias("query"), "dim", "table", "slot").join(index, ["dim", "table", "slot"]).filter("id <> query")
    found = met.groupBy("query", "id").agg(F.count("table").alias("tables"))
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("tables"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def bucket_stats(index: DataFrame) -> DataFrame:
    """Per length: vectors, buckets, mean and largest bucket."""
    sizes = index.groupBy("dim", "table", "slot").agg(F.count("id").alias("n"))
    vectors = index.groupBy("dim").agg(F.countDistinct("id").alias("vectors"))
    return sizes.groupBy("dim").agg(F.count("n").alias("buckets"), F.avg("n").alias("mean_bucket"), F.max("n").alias("largest_bucket")).join(vectors, "dim")
