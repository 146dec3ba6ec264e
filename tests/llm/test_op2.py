import numpy as np

from weftline.llm import op2_neardup as op2


def brute(rows, cosine=0.9):
    """Per row: links, component."""
    x = np.zeros((len(rows), max([len(v) for _, v in rows if v] or [1])))
    for i, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            x[i, : len(v)] = v
    norm = np.linalg.norm(x, axis=1)
    good = norm > 0
    u = x / np.where(good, norm, 1)[:, None]
    near = (u @ u.T >= cosine) & good[:, None] & good[None]
    np.fill_diagonal(near, False)
    seen, out = np.full(len(rows), -1), []
    for i in range(len(rows)):
        if seen[i] < 0:
            stack, seen[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if seen[j] < 0:
                        seen[j] = i
                        stack.append(j)
    for i, (vid, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(seen == seen[i]) if rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((vid, int(near[i].sum()), name, vid is not None and vid == name))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = op2.group(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_edges(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    check(spark, [(1, a), (2, a), (2, a), (3, b), (None, b), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [0.0, 1.0]), (11, [0.0, 2.0, 0.0]), (12, [1e-30, 0.0, 0.0])])
    assert op2.group(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chains_dense_groups_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    hot = rng.normal(size=24)
    for _ in range(220):
        rows.append((hot + 0.05 * rng.normal(size=24)).tolist())
    walk = rng.normal(size=24)
    for _ in range(60):
        rows.append(walk.tolist())
        walk = walk + 0.06 * rng.normal(size=24) * np.linalg.norm(walk) / 4
    rows += rng.normal(size=(300, 24)).tolist()
    rows += rows[:30]
    data = [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    check(spark, data)
    monkeypatch.setattr(op2, "BLOCK", 100)
    monkeypatch.setattr(op2, "CLUSTER", 50)
    check(spark, data)


def test_query_and_recall(spark, sf_dir):
    out = op2.op2_neardup(spark, "/root/testdata/sf0.1")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in rows.collect()])
    got = {r.vec_id: tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()}
    links, have = sum(w[1] for w in want), sum(min(got[w[0]][1], w[1]) for w in want)
    assert have >= 0.99 * links and all(got[w[0]][1] <= w[1] for w in want)
    assert op2.recall(rows, out) >= 0.9


def test_prune_keeps_the_nearest():
    x = op2.unit(np.random.default_rng(0).normal(size=(200, 8)))
    graph = op2.build(x)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    assert (graph[:, 0] == s.argmax(axis=1)).all()
    assert (graph[:, -1] >= 0).all()


def test_recall_over_many_shards(spark, monkeypatch):
    """Pairs just above the threshold, some hundred shards: linked pairs must meet in one."""
    monkeypatch.setattr(op2, "CLUSTER", 48)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.902, 0.92, (len(x), 1))
    both = np.vstack([x, c * x + np.sqrt(1 - c * c) * z])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in op2.group(rows).collect()}
    assert all(r.n_links <= 1 for r in got.values())
    found = sum(got[i + 2500].component_id == i for i in range(2500))
    print("recall", found / 2500)
    assert found >= 0.98 * 2500


def test_vectors_that_share_a_direction(spark, monkeypatch):
    """All cosines above 0.8 and most below 0.9: still many centres, and all links."""
    monkeypatch.setattr(op2, "CLUSTER", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x[:, 0] += 20.0
    near = x[:60] + 0.5 * rng.normal(size=(60, 64))
    data = [(i, v) for i, v in enumerate(np.float32(np.vstack([x, near])).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("node", op2.F.lit(1)).withColumn("vec", op2.F.lit("x"))
    got = op2.group(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(data)))


def test_bounded_waves(monkeypatch):
    monkeypatch.setattr(op2, "WAVE", 5_000)
    rng = np.random.default_rng(9)
    x = op2.unit(np.vstack([rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(700, 16)), rng.normal(size=(300, 16))]))
    g = op2.build(x)
    graph = op2.two_way(np.repeat(np.arange(len(x)), (g >= 0).sum(axis=1)), g[g >= 0], len(x))
    got = [pair for q, m in op2.search(x, graph, 0, np.arange(len(x)), 0.9) for pair in zip(q.tolist(), m.tolist(), strict=True)]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
