"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes go to overlapping cluster shards: that of the nearest centre and those nearly as near.
Each shard builds a flat graph, a node's neighbours pruned so that none is much nearer to another neighbour than to the
node; the shards' adjacency lists are united. Then every node searches its shards greedily from the shard's medoid over
the united lists, and once within reach expands by range: all neighbours of what is near enough, until nothing new is.
Cosines are verified in double precision, and each pair counts in the first shard that holds both ends. Only counts and
one spanning link for each node leave a task, never all pairs of a dense group.

Centres are a bounded sample of the nodes, none within the threshold of another, so a dense group stays in one cluster. A
node's number of clusters grows with the logarithm of their number, which keeps the share of linked pairs that meet in
one. A cluster beyond
BLOCK nodes is cut into blocks, and every two blocks are a shard: no task grows with the cluster, and nothing is capped.
`recall` audits the links against brute force for a sample of nodes.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing, and so do rows of
an empty table; shorter vectors count as continued with zeros; repeated rows link with each other; a null id takes part
but names no component unless all ids there are null (the component is null then, and `kept` false). Other columns than
id and vector are not carried, so clashing names can't arise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, read, release
from weftline.llm.components import components
from weftline.llm.vectors import dense, matrix, spread_sample, stored, unit

COSINE = 0.9
#: Nodes a cluster should have, most clusters, and rows of the sample that centres are taken from, per centre.
CLUSTER, MOST_CENTRES, POOL = 2_048, 65_536, 2
#: A node also belongs to clusters whose centre is at most this much farther (cosine), `overlap` in all.
MARGIN = 0.3
#: Pairs of a query and a node that a block of searches holds at once.
WAVE = 1 << 21
#: Most nodes of a shard's side.
BLOCK = 16_384
DEGREE, CANDIDATES, ALPHA = 16, 48, 1.2
#: Cosine from which a search goes on expanding.
REACH = 0.6
BEAM = 8


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none), up to `degree` of which none is `alpha` times nearer to one taken before than to the row."""
    out = np.full((len(near), degree), -1, np.int32)
    for at in range(0, len(near), 256):
        cand = near[at : at + 256]
        v = x[cand]
        away = 2 - 2 * np.einsum("nd,ncd->nc", x[at : at + 256], v)
        among = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        open_ = cand >= 0
        line = np.arange(len(cand))
        for k in range(degree):
            some = open_.any(axis=1)
            if not some.any():
                break
            pick = open_.argmax(axis=1)
            out[at + line[some], k] = cand[line[some], pick[some]]
            open_ &= ~((alpha * alpha * among[line, pick] <= away) & some[:, None])
            open_[line, pick] = False
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Flat graph over unit vectors: each row's nearest candidates, pruned, and one long-range edge."""
    n = len(x)
    most = min(CANDIDATES, n - 1)
    if most < 1:
        return np.full((n, DEGREE), -1, np.int32)
    x = x.astype(np.float32)
    near = np.empty((n, most), np.int32)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        near[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    out = robust_prune(x, near)
    # long-range edges along a fixed permutation keep the graph connected
    order = np.random.Generator(np.random.PCG64(5)).permutation(n)
    out[order, -1] = np.roll(order, 1)
    return out


def two_way(source: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges and their reverses by source: where each row's begin, how many they are, and all targets end to end."""
    key = np.unique(np.concatenate([source * n + target, target * n + source]).astype(np.int64))
    degree = np.bincount(key // n, minlength=n)
    return np.cumsum(degree) - degree, degree, key % n


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest row of each component) after the edges a-b; `parent` holds roots before."""
    while True:
        p, q = parent[a], parent[b]
        apart = p != q
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray, np.ndarray], entry: int, queries: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of query rows: pairs (query, found) with cosine at least `cosine`, the query itself left out."""
    n = len(x)
    first, degree, flat = graph
    single = x.astype(np.float32)
    wide = max(16, min(512, WAVE // n))  # what a block has seen, and so its waves, stay within WAVE pairs
    for at in range(0, len(queries), wide):
        own = queries[at : at + wide]
        seen = np.zeros((len(own), n), np.bool_)
        line = np.arange(len(own))
        seen[line, own] = True
        seen[:, entry] = True
        # the node's own neighbours are where a search for itself would end: start there too
        q0, n0 = _unseen(line, own, first, degree, flat, seen)
        rows, nodes = np.concatenate([line, q0]), np.concatenate([np.full(len(own), entry), n0])
        found_q, found_n = [], []
        best = np.full(len(own), -2.0, np.float32)
        while len(rows):
            sims = np.empty(len(rows), np.float32)
            for k in range(0, len(rows), 65_536):
                sims[k : k + 65_536] = np.einsum("ij,ij->i", single[own[rows[k : k + 65_536]]], single[nodes[k : k + 65_536]])
            hit = sims >= cosine - 1e-4
            found_q.append(rows[hit])
            found_n.append(nodes[hit])
            before = best.copy()
            np.maximum.at(best, rows, sims)
            # greedy: the BEAM best newcomers of queries that still improve; range: everything near enough
            order = np.lexsort((-sims, rows))
            place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
            go = np.zeros(len(rows), np.bool_)
            go[order[place < BEAM]] = True
            go &= (best > before)[rows]
            go |= sims >= REACH
            # expanding would look at more than all nodes: look at all that are left at once
            dense = np.flatnonzero(np.bincount(rows[go], degree[nodes[go]], len(own)) >= n)
            if len(dense):
                r, m = np.nonzero((single[own[dense]] @ single.T >= cosine - 1e-4) & ~seen[dense])
                found_q.append(dense[r])
                found_n.append(m)
                seen[dense] = True
                go &= ~np.isin(rows, dense)
            rows, nodes = _unseen(rows[go], nodes[go], first, degree, flat, seen)
        q, m = np.concatenate(found_q), np.concatenate(found_n)
        q = own[q]
        keep = np.empty(len(q), np.bool_)
        for k in range(0, len(q), 65_536):
            keep[k : k + 65_536] = (x[q[k : k + 65_536]] * x[m[k : k + 65_536]]).sum(axis=1) >= cosine
        keep &= q != m
        yield q[keep], m[keep]


def _unseen(rows, nodes, first, degree, flat, seen):
    """Pairs (row, neighbour) not seen so far, once each, now marked as seen; taken in pieces of about WAVE neighbours."""
    many = degree[nodes]
    ends = np.cumsum(many)
    out_r, out_n, at = [], [], 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WAVE, side="right")))
        part = many[at:stop]
        inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        r, m = np.repeat(rows[at:stop], part), flat[np.repeat(first[nodes[at:stop]], part) + inside]
        new = ~seen[r, m]
        key = np.unique(r[new].astype(np.int64) * seen.shape[1] + m[new])
        r, m = key // seen.shape[1], key % seen.shape[1]
        seen[r, m] = True
        out_r.append(r)
        out_n.append(m)
        at = stop
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_r, out_n))


def overlap(centres: int) -> int:
    """Clusters of a node, more where there are more: 99.8 % or more of random pairs in 64 dimensions at cosine 0.91 share one (measured with 26, 128, 1,024 and 16,384 centres)."""
    return max(4, math.ceil(math.log2(max(centres, 1))) - 1)


def _shards(nodes: DataFrame) -> DataFrame:
    """`shard, side, node, vec, n, clusters`: every node once for each shard that it belongs to."""
    total = nodes.count()
    wanted = min(MOST_CENTRES, max(1, math.ceil(total / CLUSTER)))
    centres = spread_sample(nodes, wanted, max(1024, POOL * wanted), COSINE).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                s = unit(matrix(part.column(1))).astype(np.float32) @ centres.T
                most = min(overlap(len(centres)), s.shape[1])
                top = np.argpartition(-s, most - 1, axis=1)[:, :most]
                near = np.take_along_axis(s, top, 1) >= s.max(axis=1, keepdims=True) - MARGIN
                own = [np.sort(t[k]).tolist() for t, k in zip(top, near, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own, pa.list_(pa.int32()))], names=["node", "vec", "n", "clusters"])

    placed = materialize(nodes.select("node", "vec", "n").mapInArrow(run, "node long, vec binary, n long, clusters array<int>"), "placed")
    each = placed.withColumn("cluster", F.explode("clusters"))
    blocks = each.groupBy("cluster").agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("blocks"))
    cut = each.join(F.broadcast(blocks), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # shard (i, j) of a cluster holds blocks i <= j; side 0 is block i
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("i"), F.greatest(other, F.col("block")).alias("j")))
    return cut.withColumn("p", F.explode(pairs)).select(F.concat_ws(":", "cluster", "p.i", "p.j").alias("shard"), F.col("cluster"), (F.col("block") != F.col("p.i")).cast("int").alias("side"), "node", "vec", "n", "clusters", (F.col("p.i") == F.col("p.j")).alias("whole"))


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """`node, found, root`: how many rows of other nodes each node links with, and a spanning link, shard by shard."""
    shards = materialize(_shards(nodes), "shards")

    def make(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        graph = build(unit(matrix(table.column("vec"))))
        lists = [node[g[g >= 0]] for g in graph]
        return pa.table({"node": pa.array(node), "near": pa.array(lists, pa.list_(pa.int64()))})

    built = shards.select("shard", "node", "vec").groupBy("shard").applyInArrow(make, "node long, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def find(table: pa.Table) -> pa.Table:
        node, side, n = (table.column(c).to_numpy() for c in ("node", "side", "n"))
        whole, cluster = table.column("whole")[0].as_py(), table.column("cluster")[0].as_py()
        x = unit(matrix(table.column("vec")))
        order = np.argsort(node)
        lists = table.column("near").combine_chunks()
        near = lists.flatten().to_numpy()
        source = np.repeat(np.arange(len(node)), lists.value_lengths().fill_null(0).to_numpy())
        at = order[np.minimum(np.searchsorted(node, near, sorter=order), len(node) - 1)]
        here = node[at] == near
        graph = two_way(source[here], at[here], len(node))
        owns = [np.array(c) for c in table.column("clusters").to_pylist()]
        first = np.array([c[0] for c in owns])
        wide = max(map(len, owns))
        padded = np.array([np.pad(c, (0, wide - len(c)), constant_values=-1) for c in owns])
        entry = int((x @ x.mean(axis=0)).argmax())
        found, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for q, m in search(x, graph, entry, np.arange(len(node)), cosine):
            keep = np.ones(len(q), np.bool_) if whole else side[q] != side[m]
            check = np.flatnonzero(keep & (first[q] < cluster) & (first[m] < cluster))  # both have earlier clusters: the pair counts in the first that they share
            for k in range(0, len(check), 16_384):
                some = check[k : k + 16_384]
                x1, x2 = padded[q[some]], padded[m[some]]
                keep[some] = ~((x1[:, :, None] == x2[:, None, :]) & (x1 >= 0)[:, :, None] & (x1 < cluster)[:, :, None]).any(axis=(1, 2))
            q, m = q[keep], m[keep]
            found += np.bincount(q, n[m], len(node)).astype(np.int64)
            root = joined(root, q, m)
        some = np.flatnonzero(found > 0)
        return pa.table({"node": pa.array(node[some]), "found": pa.array(found[some]), "root": pa.array(node[root[some]])})

    full = shards.join(united, "node", "left")
    out = materialize(full.groupBy("shard").applyInArrow(find, "node long, found long, root long"), "links")
    release(shards)
    return out


def group(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: id, `n_links`, `component_id`, `kept`."""
    rows = stored(df, id_col, vector_col, "vectors")
    nodes = rows.groupBy("vec").agg(F.count("row").alias("n"), F.min("row").alias("node"))
    nodes = materialize(nodes, "nodes")
    found = links(nodes.select("node", "vec", "n"), cosine)
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(counts, "node", "left").join(joined, "node", "left").select("vec", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    placed = rows.join(named, "vec").select("row", "id", "links", "component")
    names = placed.groupBy("component").agg(F.min("id").alias("name"))
    good = placed.join(names, "component").select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("name").alias("component_id"))
    return good.unionByName(_unusable(df, id_col, vector_col)).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _unusable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            _, good = dense(batch.column(1), max(1, int(lengths.max()) if len(lengths) else 1))
            bad = np.ones(batch.num_rows, np.bool_)
            bad[good] = False
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad))], names=["id"])

    typed = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return typed.mapInArrow(run, f"id {kind}").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))


def recall(df: DataFrame, grouped: DataFrame, queries: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> float:
    """Share of the true links of `queries` rows (smallest id hashes; ids must be unique) that `grouped` counts."""
    rows = stored(df, id_col, vector_col, "audit")
    chosen = rows.orderBy(F.xxhash64("id")).limit(queries).collect()
    if not chosen:
        return 1.0
    x = unit(np.frombuffer(b"".join(r["vec"] for r in chosen)).reshape(len(chosen), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = (unit(matrix(batch.column(0))) @ x.T >= cosine).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(hits.astype(np.int64))], names=["q", "hits"])

    true = {r["q"]: r["hits"] - 1 for r in rows.select("vec").mapInArrow(run, "q long, hits long").groupBy("q").agg(F.sum("hits").alias("hits")).collect()}
    ids = [r["id"] for r in chosen]
    have = {r[0]: r[1] for r in grouped.filter(F.col(id_col).isin(ids)).select(id_col, "n_links").collect()}
    return sum(min(true[i], have[k]) for i, k in enumerate(ids)) / max(1, sum(true.values())) if sum(true.values()) else 1.0


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9),
reach AS (SELECT r AS node, r AS seen FROM usable UNION SELECT reach.node, l.b FROM reach JOIN links l ON reach.seen = l.a),
named AS (SELECT node, min(vec_id) AS component_id FROM reach JOIN usable ON seen = r GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM usable JOIN named ON r = node LEFT JOIN counted ON r = a
UNION ALL
SELECT vec_id, 0::BIGINT, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
