"""Steps whose work or traffic must not grow beyond their input."""

import numpy as np
import pytest

from weftline.operators import codec, history, index
from weftline.plans import catalog


def brute(x, q, most):
    bits = np.bitwise_count(x[None] ^ q[:, None]).sum(axis=2)
    return {(int(i), int(j)): int(bits[i, j]) for i, j in zip(*np.nonzero(bits <= most), strict=True)}


@pytest.mark.parametrize("words, most", [(1, 0), (1, 6), (1, 30), (2, 6), (2, 200)])
def test_scan_compares_parts_of_the_pairs(monkeypatch, words, most):
    rng = np.random.default_rng(words + most)
    x = rng.integers(0, 2**52, (4000, words), dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:300] ^ np.uint64(0b101011), x[:300] ^ np.uint64(1 << 40)]), axis=0)
    q = np.concatenate([x[::40], x[:20] ^ np.uint64(1 << 63)])
    compared, differing = [], index._differing
    monkeypatch.setattr(index, "_differing", lambda a, b: compared.append(np.broadcast_shapes(a.shape, b.shape)) or differing(a, b))
    for at_once in (1 << 21, 1000):
        monkeypatch.setattr(index, "AT_ONCE", at_once)
        compared.clear()
        got = [(int(i), int(j), int(d)) for rows in index.within(x, q, most) for i, j, d in zip(*rows, strict=True)]
        want = brute(x, q, most)
        assert len(got) == len(want) and {(i, j): d for i, j, d in got} == want
        if most <= 6:
            assert sum(np.prod(s[:-1]) for s in compared) < len(x) * len(q) / 10


@pytest.mark.parametrize("limit", [None, 3])
def test_scan_against_brute_force_in_small_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(index, "BLOCK", 50)
    monkeypatch.setattr(index, "CHUNK", 20)
    rng = np.random.default_rng(5)
    fps = {i: [int(v) for v in rng.integers(-(2**62), 2**62, 1 + i % 2)] for i in range(300)}
    fps |= {i: fps[i % 7] for i in range(300, 340)} | {340 + i: [fps[2 * i][0] ^ 0b1011] for i in range(20)} | {360: [], 362: []}
    rows = [(i, 1 + i % 2 if i < 340 else 1, fp) for i, fp in fps.items()]
    table = spark.createDataFrame([*rows, rows[4], (400, 1, None), (None, 1, fps[0])], "id long, dim int, fp array<long>")
    found = index.scan(table, table.filter("id % 3 = 0"), 6, limit).collect()
    far = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    want = set()
    for q, dim, fp in rows:
        if q % 3 == 0:
            near = sorted((far(fp, other), i) for i, d, other in rows if d == dim and len(other) == len(fp) and i != q and far(fp, other) <= 6)
            want |= {(q, i, bits) for bits, i in near[:limit]}
    got = {(r["query"], r["id"], r["distance"]) for r in found if r["id"] is not None}
    assert got == want and len(want) > 40


def test_scan_of_one_fingerprint_takes_its_first_ids(spark):
    """Before, each asked row met all 40,000 others."""
    table = spark.range(40_000).selectExpr("id", "1 AS dim", "array(5L) AS fp")
    assert index.scan(table, table.filter("id % 2 = 0"), 6, 2).selectExpr("count(*) AS n", "sum(id) AS ids", "max(distance) AS most").first()[:] == (40_000, 20_002, 0)  # 1 and 2 of the first, 0 and 1 of all others


@pytest.fixture
def sent(spark):
    """Sets the most bytes of a table that may be sent to the executors by way of the driver; more is an error."""
    key = "spark.sql.maxBroadcastTableSize"
    yield lambda most: spark.conf.set(key, most)
    spark.conf.unset(key)


def history_edges(spark, n):
    """A binary tree of 1 to n - 1 where every tenth commit also has the one before its parent."""
    first = spark.range(2, n).selectExpr("id AS child", "id div 2 AS parent", "0 AS place")
    return first.unionByName(first.filter("child % 10 = 0 AND parent > 1").selectExpr("child", "parent - 1 AS parent", "1 AS place"))


def test_a_path_does_not_send_the_edges_to_the_driver(spark, sent, monkeypatch):
    monkeypatch.setattr(history, "SMALL", 0, raising=False)
    edges = history_edges(spark, 200_000)
    sent(1)
    rows = history.path(edges, spark.createDataFrame([(1, 150_000), (7, 150_000), (150_000, 150_000)], "a long, b long")).orderBy("a", "step").collect()
    up = {150_000: 0}
    front = [150_000]
    while front:
        front = sorted({p for c in front for p in ([c // 2] if c > 1 else []) + ([c // 2 - 1] if c % 10 == 0 and c // 2 > 1 else [])} - up.keys())
        up |= dict.fromkeys(front, max(up.values()) + 1)
    want = []
    for a in (1, 7, 150_000):
        node = a if a in up else None
        step = 0
        while node is not None:
            want.append((a, 150_000, step, node))
            below = [c for c in up if (c // 2 == node or c % 10 == 0 and c // 2 - 1 == node) and up[c] == up[node] - 1]
            node, step = min(below, default=None), step + 1
    assert [tuple(r) for r in rows] == want and len(want) > 10


@pytest.mark.parametrize("small", [0, 20_000])
def test_descendants_do_not_send_the_edges_to_the_driver(spark, sent, monkeypatch, small):
    monkeypatch.setattr(history, "SMALL", small, raising=False)
    edges = history_edges(spark, 200_000)
    if small == 0:
        sent(1)
    got = [r[:] for r in history.descendants(edges, spark.createDataFrame([(7,), (200_001,)], "src long")).select("src", "node", "depth").collect()]
    want, front = {7: 0}, {7}
    children = {}
    for c in range(2, 200_000):
        for p in {c // 2} | ({c // 2 - 1} if c % 10 == 0 else set()):
            children.setdefault(p, []).append(c)
    while front:
        front = {c for p in front for c in children.get(p, [])} - want.keys()
        want |= dict.fromkeys(front, max(want.values()) + 1)
    assert sorted(got) == sorted((7, n, d) for n, d in want.items() if d) and len(got) >= 25_000


def test_logs_do_not_send_the_edges_to_the_driver(spark, sent):
    edges = history_edges(spark, 200_000)
    tips = spark.createDataFrame([(150_000,), (1,)], "src long")
    sent(2 << 20)
    got = sorted(r[:] for r in history.log(edges, tips, 1000).select("src", "node", "depth").collect())
    assert got == [(1, 1, 0)] + sorted((150_000, 150_000 >> k, k) for k in range(18))


def test_round_trips_take_one_python_worker_a_task(spark, sf_dir, capsys):
    catalog.queries()["xor_round_trips"](spark, sf_dir).explain()
    assert capsys.readouterr().out.count("EvalPython") == 1
    rng = np.random.default_rng(7)
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(rng.normal(size=(5, 2, 16)).astype(np.float32).astype(float))]
    pairs = spark.createDataFrame([*rows, (5, [1.0], [1.0, 2.0]), (6, None, [1.0]), (7, [], [])], "name int, va array<double>, vb array<double>")
    for kind in codec.KINDS:
        apart = {r["name"]: r["restored"] for r in codec.decode(codec.encode(pairs, kind).withColumn("kind", codec.F.lit(kind))).collect()}
        assert {r["name"]: r["restored"][kind] for r in codec.round_trips(pairs, (kind,)).collect()} == apart
    both = {r["name"]: r["restored"] for r in codec.round_trips(pairs).collect()}
    assert all(both[n][kind] == b for n, _, b in rows for kind in codec.LOSSLESS) and both[5]["xor_float32"] is None and both[6]["xor_bfloat16"] is None
    with pytest.raises(ValueError):
        codec.round_trips(pairs, ("other",))
