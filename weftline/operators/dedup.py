"""Exact and near deduplication of tensors: hashes, an exact similarity join, SimHash fingerprints with bit-sliced buckets, and sequential assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.operators.lineage import cut

BITS, TABLES = 64, 4
#: Rows of a side of the exact join's tasks.
BLOCK = 16_384


def exact(rows: DataFrame, key: str, content: str) -> DataFrame:
    """`hash, first, copies` of equal contents; the smallest key is the reference."""
    digest = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary"), 256)
    return rows.groupBy(digest.alias("hash")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))


def exact_assignment(rows: DataFrame, key: str, content: str) -> DataFrame:
    """`key, first, kind` for every row: unique, or duplicate of the first of its content."""
    digest = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary"), 256)
    named = rows.select(key, digest.alias("hash"))
    refs = named.groupBy("hash").agg(F.min(key).alias("first"))
    return named.join(refs, "hash").select(key, "first", F.when(F.col(key) == F.col("first"), "unique").otherwise("duplicate").alias("kind"))


def savings(assigned: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Totals of an assignment: rows, uniques, duplicates, bytes before and after, saved bytes and their share."""
    rows = assigned.join(sizes, key)
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "unique").alias("unique_rows"), F.count_if(F.col("kind") != "unique").alias("duplicates"), F.sum("bytes").alias("original_bytes"), F.sum(F.when(F.col("kind") == "unique", F.col("bytes")).otherwise(0)).alias("stored_bytes"))
    saved = F.col("original_bytes") - F.col("stored_bytes")
    return out.withColumns({"saved_bytes": saved, "saved_share": F.when(F.col("original_bytes") > 0, saved / F.col("original_bytes")).otherwise(0.0)})


def largest_groups(assigned: DataFrame, sizes: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Groups that save most bytes."""
    rows = assigned.join(sizes, key).filter("kind <> 'unique'")
    return rows.groupBy("first").agg(F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("saved")).orderBy(F.desc("saved"), "first").limit(limit)


def planes(dim: int, bits: int = BITS, seed: int = 42) -> np.ndarray:
    p = np.random.RandomState(seed).randn(bits, dim)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def by_length(values: pd.Series, fn) -> list:
    """`fn(matrix)` for the rows of each length at once, results in the rows' order; null rows give None."""
    out: list = [None] * len(values)
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            groups.setdefault(len(v), []).append(i)
    for rows in groups.values():
        for i, r in zip(rows, fn(np.stack([np.asarray(values.iloc[i], float) for i in rows])), strict=True):
            out[i] = r
    return out


def fingerprint(model: DataFrame, bits: int = BITS, seed: int = 42) -> DataFrame:
    """Adds `fp`: the signs of `bits` seeded projections as one long; lengths have planes of their own."""

    @F.pandas_udf("long")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        signs = lambda x: ((x @ planes(x.shape[1], bits, seed).T > 0) * weight).sum(axis=1, dtype=np.uint64).view(np.int64)
        for values in batches:
            yield pd.Series(by_length(values, signs))

    return model.withColumn("fp", project("values"))


def buckets(model: DataFrame, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """`name, dim, band, slot, fp`: each fingerprint cut into `tables` slices, a row for each."""
    width = bits // tables
    slot = lambda t: F.shiftrightunsigned("fp", t * width).bitwiseAND(F.lit((1 << width) - 1))
    bands = F.explode(F.array(*[F.struct(F.lit(t).alias("band"), slot(t).alias("slot")) for t in range(tables)]))
    return model.select("name", F.size("values").alias("dim"), "fp", bands.alias("b")).select("name", "dim", "fp", "b.band", "b.slot")


def near_pairs(model: DataFrame, most: int = 3, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """`a, b, distance` with a < b: equal length, `most` differing bits at most. Slices number more than bits may differ, so one is equal."""
    if most >= tables:
        raise ValueError("more bits may differ than there are slices")
    rows = buckets(model, bits, tables)
    left, right = rows.select("dim", "band", "slot", F.col("name").alias("a"), F.col("fp").alias("fa")), rows.select("dim", "band", "slot", F.col("name").alias("b"), F.col("fp").alias("fb"))
    met = left.join(right, ["dim", "band", "slot"]).filter("a < b").withColumn("distance", S.hamming(F.col("fa"), F.col("fb"))).filter(F.col("distance") <= most)
    return met.select("a", "b", "distance").distinct()


def close_pairs(model: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """`a, b` with a < b: all pairs of equal length that can pass direction and magnitude, and a few just below.

    Each length's rows are cut into blocks of about BLOCK, and every two blocks meet in one task. Directions are single
    precision there, so the bound is lowered by what rounding can take. Zero tensors are a direction of their own; those
    that are null or hold null or non-finite components have no pairs.
    """
    kind = model.schema["name"].dataType.simpleString()
    apart = 1e-9 - np.log(1.0 - tolerance) if tolerance < 1 else np.inf

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                good, vecs, sizes = [], [], []
                for i in range(part.num_rows):
                    v = np.asarray(part.column(1)[i].values.fill_null(np.nan).to_numpy(zero_copy_only=False), float)
                    if not np.isfinite(v).all():
                        continue
                    top = np.abs(v).max(initial=0.0)
                    v = v / top if top else v
                    norm = np.sqrt(v @ v) if top else 1.0
                    good.append(i)
                    vecs.append(np.append(v / norm, 0.0 if top else 1.0).astype(np.float32).tobytes())
                    sizes.append(float(np.log(top) + np.log(norm)) if top else 0.0)
                names = part.column(0).take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([names, pa.array(vecs, pa.binary()), pa.array(sizes, pa.float64())], names=["name", "vec", "size"])

    def meet(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(table.num_rows, -1)
        size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = table.column("alone")[0].as_py()
        right = left if alone else right
        least = threshold - 1.2e-7 * (x.shape[1] + 8)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        y = x[right].T
        for at in range(0, len(left), 512):
            i, j = np.nonzero(x[left[at : at + 512]] @ y >= least)
            i += at
            keep = np.abs(size[left[i]] - size[right[j]]) <= apart
            if alone:
                keep &= i < j
            found.append((left[i[keep]], right[j[keep]]))
        a, b = (pa.array(np.concatenate(f)) for f in zip(*found, strict=True))
        return pa.table([table.column("name").take(a), table.column("name").take(b)], names=["x", "y"])

    rows = model.select("name", F.col("values").cast("array<double>").alias("values")).filter("name is not null and values is not null")
    cuts = rows.groupBy(F.size("values").alias("dim")).agg(F.ceil(F.count("name") / BLOCK).cast("int").alias("blocks"))
    tasks = cuts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    made = rows.mapInArrow(directions, f"name {kind}, vec binary, size double")
    made = made.withColumn("dim", (F.length("vec") / 4 - 1).cast("int")).join(F.broadcast(cuts), "dim").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    # task (i, j) of a length holds blocks i <= j; side 0 is block i
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("i"), F.greatest(other, F.col("block")).alias("j")))
    each = made.withColumn("p", F.explode(meets))
    each = each.select(F.concat_ws(":", "dim", "p.i", "p.j").alias("task"), (F.col("block") != F.col("p.i")).cast("int").alias("side"), (F.col("p.i") == F.col("p.j")).alias("alone"), "name", "vec", "size")
    met = each.repartition(int(min(1000, 4 * tasks)), "task").groupBy("task").applyInArrow(meet, f"x {kind}, y {kind}")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def similar_pairs(model: DataFrame, threshold: float = 0.98, tolerance: float = 0.1, approximate: bool = False) -> DataFrame:
    """`a, b, score` of all pairs that pass direction, magnitude and hybrid score.

    With `approximate` only pairs whose SimHash fingerprints differ in 3 bits at most are looked at: of those at cosine
    0.98 about 41 %, at 0.99 about 67 %.
    """
    values = model.select("name", "values")
    pairs = near_pairs(fingerprint(model)) if approximate else close_pairs(model, threshold, tolerance)
    pairs = pairs.join(values.select(F.col("name").alias("a"), F.col("values").alias("va")), "a").join(values.select(F.col("name").alias("b"), F.col("values").alias("vb")), "b")
    pairs = pairs.withColumns({"cos": S.cosine(F.col("va"), F.col("vb")), "mag": S.magnitude(F.col("va"), F.col("vb"))})
    return pairs.filter(S.matches(F.col("cos"), F.col("mag"), threshold, tolerance)).select("a", "b", S.hybrid(F.col("cos"), F.col("mag")).alias("score"))


def assign(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """`name, kind, ref, score`: in name order, each is similar to its best earlier unique one, or else unique itself.

    Rounds over all undecided at once: without an undecided or unique earlier neighbour one is unique; with a unique one
    it is similar. The result equals going one by one.
    """
    pairs = cut(pairs)
    state = cut(names.select("name", F.lit(None).cast("string").alias("kind")))
    while True:
        before = pairs.join(state.select(F.col("name").alias("a"), F.col("kind").alias("ka")), "a")
        seen = before.groupBy(F.col("b").alias("name")).agg(F.bool_or(F.col("ka") == "unique").alias("near"), F.bool_or(F.col("ka").isNull()).alias("waits"))
        step = state.join(seen, "name", "left")
        kind = F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.coalesce("near", F.lit(False)), "similar").when(~F.coalesce("waits", F.lit(False)), "unique")
        state = cut(step.select("name", kind.alias("kind")))
        if state.filter("kind is null").isEmpty():
            break
    refs = pairs.join(state.filter("kind = 'unique'").select(F.col("name").alias("a")), "a")
    best = refs.groupBy(F.col("b").alias("name")).agg(F.max("score").alias("score"))
    best = refs.join(best.withColumnRenamed("name", "b"), ["b", "score"]).groupBy(F.col("b").alias("name"), "score").agg(F.min("a").alias("ref"))
    out = state.join(best, "name", "left")
    similar = F.col("kind") == "similar"
    return out.select("name", "kind", F.when(similar, F.col("ref")).otherwise(F.col("name")).alias("ref"), F.when(similar, F.col("score")).alias("score"))


def assign_all(model: DataFrame, pairs_of=similar_pairs) -> DataFrame:
    """`name, kind, ref, score` with exact copies: equal tensors are compared once, by their first name.

    Later copies of a unique tensor are its duplicates; copies of a similar one are similar to the same reference.
    """
    copies = model.filter("values is not null").groupBy("values").agg(F.min("name").alias("first"))
    firsts = cut(copies.select(F.col("first").alias("name"), "values"))
    decided = cut(assign(firsts.select("name"), pairs_of(firsts)).withColumnRenamed("name", "first"))
    # a name finds its first by the tensor's digest, so no array is a join key
    digest = F.sha2(F.to_json(F.struct("values")).cast("binary"), 256)
    named = model.select("name", digest.alias("h")).join(firsts.select(F.col("name").alias("first"), digest.alias("h")), "h", "left").drop("h")
    out = named.join(decided, "first", "left")
    kind = F.when(F.col("kind").isNull(), "unique").when((F.col("kind") == "unique") & (F.col("name") != F.col("first")), "duplicate").otherwise(F.col("kind"))
    return out.select("name", kind.alias("kind"), F.coalesce("ref", "name").alias("ref"), "score")


def best_reference(model: DataFrame, references: DataFrame, threshold: float = 0.98, tolerance: float = 0.1) -> DataFrame:
    """`name, ref, score`: of stated references the best that each tensor is similar to, the smallest name among equals."""
    both = model.select(F.struct(F.lit(1).alias("side"), F.col("name")).alias("name"), "values").unionByName(references.select(F.struct(F.lit(0).alias("side"), F.col("name")).alias("name"), "values"))
    pairs = similar_pairs(both, threshold, tolerance).filter("a.side = 0 and b.side = 1")
    return pairs.groupBy(F.col("b.name").alias("name")).agg(F.min_by(F.struct("score", F.col("a.name").alias("ref")), F.struct(F.negate("score"), F.col("a.name"))).alias("r")).select("name", "r.ref", "r.score")


def group_of(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """`wanted, name, kind`: all members of each wanted name's group."""
    refs = assigned.join(names.select(F.col("name").alias("wanted")), F.col("name") == F.col("wanted")).select("wanted", "ref")
    return refs.join(assigned.select("ref", "name", "kind"), "ref").select("wanted", "name", "kind")


def statistics(assigned: DataFrame, sizes: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Counts and bytes of an assignment: a similar tensor is charged its delta's bytes, or half its own without one."""
    rows = assigned.join(sizes.select("name", "bytes"), "name")
    rows = rows.withColumn("delta", F.lit(None).cast("long")) if deltas is None else rows.join(deltas.select("name", F.col("bytes").alias("delta")), "name", "left")
    kind = lambda k: F.count_if(F.col("kind") == k)
    held = F.when(F.col("kind") == "unique", F.col("bytes")).when(F.col("kind") == "similar", F.coalesce("delta", F.floor(F.col("bytes") / 2))).otherwise(0)
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), kind("unique").alias("unique_tensors"), kind("duplicate").alias("duplicates"), kind("similar").alias("similars"), F.count("delta").alias("deltas"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(held), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum("delta"), F.lit(0)).alias("delta_bytes"), F.coalesce(F.sum(F.when(F.col("delta").isNotNull(), F.col("bytes"))), F.lit(0)).alias("delta_original"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, 1.0 - F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"saved_share": ratio("stored_bytes", "original_bytes"), "delta_share": ratio("delta_bytes", "delta_original")})


def group_savings(assigned: DataFrame, sizes: DataFrame, deltas: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Per reference: members and bytes saved; the largest `limit` groups if given."""
    rows = assigned.join(sizes.select("name", "bytes"), "name")
    rows = rows.withColumn("delta", F.lit(None).cast("long")) if deltas is None else rows.join(deltas.select("name", F.col("bytes").alias("delta")), "name", "left")
    saved = F.when(F.col("kind") == "duplicate", F.col("bytes")).when(F.col("kind") == "similar", F.col("bytes") - F.coalesce("delta", F.floor(F.col("bytes") / 2))).otherwise(0)
    out = rows.groupBy("ref").agg(F.count("name").alias("members"), F.sum(saved).cast("long").alias("saved")).filter("members > 1")
    return out if limit is None else out.orderBy(F.desc("saved"), "ref").limit(limit)


def index_stats(model: DataFrame) -> DataFrame:
    """Per length: vectors, buckets, mean and largest bucket."""
    sizes = buckets(model).groupBy("dim", "band", "slot").agg(F.count("name").alias("n"))
    return sizes.groupBy("dim").agg((F.sum("n") / TABLES).cast("long").alias("vectors"), F.count("n").alias("buckets"), F.avg("n").alias("mean_bucket"), F.max("n").alias("largest_bucket"))


def top_candidates(pairs: DataFrame, k: int = 10) -> DataFrame:
    both = pairs.select(F.col("a").alias("q"), F.col("b").alias("c"), "distance").unionByName(pairs.select(F.col("b").alias("q"), F.col("a").alias("c"), "distance"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "c"))
    return both.withColumn("place", place).filter(F.col("place") <= k)
