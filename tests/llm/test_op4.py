import numpy as np
from pyspark.sql import functions as F

from weftline.llm import op4_neighbours as op4


def brute(rows, k, every):
    x = [np.array([c for c in v], float) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v in rows]
    wide = max(len(v) for v in x if v is not None)
    x = [None if v is None else np.pad(v, (0, wide - len(v))) for v in x]
    out = []
    for i, (q, _) in enumerate(rows):
        if x[i] is None or q is None or q % every:
            continue
        cand = [(-float((x[i] * x[j]).sum()), rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i and x[j] is not None]
        for rank, (s, null, c) in enumerate(sorted(cand)[:k], 1):
            out.append((q, rank, None if null else c, -s))
    return out


def check(spark, rows, k=3, every=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = op4.neighbours(df, F.col("id") % every == 0, k).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, k, every)))


def test_edges(spark):
    a = [1.0, 2.0, 0.0]
    check(spark, [(2, a), (3, a), (4, a), (4, a), (None, a), (5, [3.0, 0.0, 0.0]), (6, None), (8, []), (10, [0.0, 0.0, 0.0]), (12, [None, 1.0, 1.0]), (14, [float("nan"), 1.0, 0.0]), (16, [1.0]), (18, [-1.0, -1.0, -5.0])])
    assert op4.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0


def test_lengths_matter_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-8, 9, 8) * (1.0 + i % 3)).tolist()) for i in range(300)]
    check(spark, rows, k=5, every=10)
    monkeypatch.setattr(op4, "LIST_BLOCK", 40)
    monkeypatch.setattr(op4, "QUERY_BLOCK", 4)
    check(spark, rows, k=5, every=10)


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = op4.op4_neighbours(spark, sf_dir).persist()
    data = [(r.vec_id, list(r.embedding)) for r in rows.collect()]
    want = {(q, c): s for q, _, c, s in brute(data, 20, 20)}
    got = found.collect()
    assert len(got) == len(want)
    assert sum((r.query_id, r.vec_id) in want for r in got) >= 0.9 * len(want)
    assert all(abs(want[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in want)
    assert op4.recall(rows, found) >= 0.9
    found.unpersist()


def test_footrule():
    rng = np.random.default_rng(0)
    ranks = np.array([rng.permutation(128) for _ in range(50)], np.uint8)
    assert (op4.footrule(ranks, ranks[3]) == np.abs(ranks.astype(int) - ranks[3].astype(int)).sum(axis=1)).all()


def test_smallest_ids_of_many_copies(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in np.vstack([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 1500, 0)])]
    ids = rng.permutation(3000)
    rows = spark.createDataFrame([(int(i), v) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")
    copies = sorted(ids[1500:].tolist())
    asked = [copies[0], copies[7], copies[900]]
    got = op4.neighbours(rows, F.col("id").isin(asked)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, c) for q in asked for c in [c for c in copies if c != q][:20]]


def measured(spark, y, step):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(y.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in op4.neighbours(rows, F.col("id") % step == 0).collect()}
    asked = np.arange(0, len(y), step)
    s = y[asked] @ y.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = {(q, c) for q, top in zip(asked.tolist(), np.argsort(-s, axis=1)[:, :20].tolist(), strict=True) for c in top}
    return len(got & want) / len(want)


def test_recall_on_vectors_that_share_a_direction(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    x[:, 0] += 20.0  # mean cosine 0.86
    assert measured(spark, x / np.linalg.norm(x, axis=1, keepdims=True), 500) >= 0.9


def test_equal_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = op4.neighbours(rows, F.col("id") == 3, 4).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(3, c, 5.0) for c in (0, 1, 2, 4)]


def test_recall_on_uneven_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for lengths in (np.exp(rng.normal(size=6000)), np.where(rng.random(6000) < 0.01, 10.0, 1.0)):
        assert measured(spark, x * lengths[:, None], 200) >= 0.9
