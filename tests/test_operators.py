import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import codec, compare, dedup, history, merge, stats, store
from weftline.operators.repository import MergeConflict, Repository, RepositoryError
from weftline.sources import tensors
from weftline.streaming import training


def model(spark, rows):
    return spark.createDataFrame([(n, 0, [float(x) for x in v]) for n, v in rows], "name string, grp int, values array<double>")


def test_similarity_of_zero_tensors_and_mismatches(spark):
    a = model(spark, [("both", [0, 0]), ("one", [0, 0]), ("len", [1, 2]), ("a", [1])])
    b = model(spark, [("both", [0, 0]), ("one", [1, 0]), ("len", [1, 2, 3]), ("b", [1])])
    got = {r["name"]: r for r in compare.compare_models(a, b).collect()}
    assert got["both"]["cos"] == 1 and got["both"]["mag"] == 1 and got["one"]["cos"] == 0
    assert got["len"]["status"] == "mismatch" and got["len"]["similarity"] == 0
    assert got["a"]["status"] == "only_a" and got["b"]["status"] == "only_b"
    assert sum(r["layers"] for r in compare.categories(compare.compare_models(a, b)).collect()) == 3


def one_by_one(names, score):
    """Sequential assignment: the plain loop."""
    unique, out = [], {}
    for n in names:
        found = [(score[u, n], -i, u) for i, u in enumerate(unique) if (u, n) in score]
        if found:
            out[n] = ("similar", max(found)[2])
        else:
            unique.append(n)
            out[n] = ("unique", n)
    return out


def test_assignment_equals_one_by_one(spark):
    rng = np.random.default_rng(4)
    score = {(a, b): round(float(rng.random()), 3) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08}
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a long, b long, score double")
    got = {r["name"]: (r["kind"], r["ref"]) for r in dedup.assign(spark.range(40).withColumnRenamed("id", "name"), pairs).collect()}
    assert got == one_by_one(range(40), score)


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, base + 0.01 * rng.normal(size=base.shape)]))]
    made = dedup.fingerprint(spark.createDataFrame(rows, "name long, values array<double>"))
    fps = {r["name"]: r["fp"] & (1 << 64) - 1 for r in made.collect()}
    want = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(made).collect()} == want and want


def test_similar_pairs_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    noise = rng.normal(size=base.shape)
    near = base + 0.13 * rng.uniform(0.5, 1.6, (60, 1)) * noise  # cosines around the threshold
    vectors = [*base, *near, *(base[:20] * 1.05), *(base[20:40] * 1.2), *(base[:10] * 1e-30), *rng.normal(size=(5, 8)), np.zeros(32), np.zeros(32), np.zeros(8), [], []]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    want = {}
    for a, v in rows:
        for b, w in rows[a + 1 :]:
            if len(v) != len(w):
                continue
            p, q = np.linalg.norm(v), np.linalg.norm(w)
            cos, mag = (1.0, 1.0) if p == q == 0 else (0.0, 0.0) if 0 in (p, q) else (np.dot(v, w) / (p * q), min(p, q) / max(p, q))
            score = 0.7 * (cos + 1) / 2 + 0.3 * mag
            if cos >= 0.98 and mag >= 0.9 and score > 0.98:
                want[a, b] = score
    extra = [(900, None), (901, [float("nan")] * 32), (902, [None] * 32), (None, [1.0] * 32)]
    made = spark.createDataFrame(rows + extra, "name long, values array<double>")
    for block in (dedup.BLOCK, 25):
        monkeypatch.setattr(dedup, "BLOCK", block)
        got = {(r["a"], r["b"]): r["score"] for r in dedup.similar_pairs(made).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assigned = {r["name"]: (r["kind"], r["ref"]) for r in dedup.assign(made.filter("name < 900"), dedup.similar_pairs(made)).collect()}
        assert assigned == one_by_one([i for i, _ in rows], got)
    some = {(r["a"], r["b"]) for r in dedup.similar_pairs(made.filter("name < 900"), approximate=True).collect()}
    assert some < want.keys()


def test_codecs_round_trip(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 40)).astype(np.float32)
    b = (a + 0.01 * rng.normal(size=a.shape)).astype(np.float32)
    pairs = spark.createDataFrame([(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b, strict=True))], "name int, va array<double>, vb array<double>")
    for r in codec.xor_decode(codec.xor_encode(pairs)).collect():
        assert np.array_equal(np.float32(r["restored"]), b[r["name"]])
    for r in codec.dequantize(codec.quantize(pairs)).collect():
        assert np.abs(np.array(r["restored"]) - b[r["name"]]).max() <= r["scale"] * 0.51
    for r in codec.from_sparse(codec.sparse(pairs)).collect():
        assert np.abs(np.array(r["restored"]) - b[r["name"]]).max() <= 1e-6
    constant = spark.createDataFrame([(0, [1.0, 2.0], [2.0, 3.0])], "name int, va array<double>, vb array<double>")
    assert codec.dequantize(codec.quantize(constant)).first()["restored"] == [2.0, 3.0]


def cells(spark, x):
    return spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(x)], "name string, pos int, x double")


def values(df):
    return [r["x"] for r in df.orderBy("pos").collect()]


def test_soups(spark):
    zero, one, half = cells(spark, [0] * 4), cells(spark, [1] * 4), cells(spark, [0.5, -2, 0.5, 0])
    assert values(merge.weighted_soup([one, half], [1, 3])) == [0.625, -1.25, 0.625, 0.25]
    assert values(merge.task_arithmetic([one, one], zero, 0.5)) == [1.0] * 4
    assert values(merge.ties([one, half], zero, 1.0)) == [0.75, -2.0, 0.75, 1.0]
    kept = values(merge.dare(cells(spark, [1] * 2000), 0.75))
    assert set(kept) == {0.0, 4.0} and 0.2 < sum(v > 0 for v in kept) / 2000 < 0.3
    assert kept == values(merge.dare(cells(spark, [1] * 2000).repartition(3), 0.75))
    assert values(merge.dare(one, 1.0)) == [0.0] * 4
    taken, soup = merge.greedy_soup([zero, one, half], lambda m: -abs(m.agg(F.avg("x")).first()[0] - 1))
    assert taken == [1] and values(soup) == [1.0] * 4
    with pytest.raises(ValueError):
        merge.weighted_soup([])


def test_graph_with_a_diamond(spark):
    edges = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 2, 0), (4, 3, 1), (5, 4, 0), (6, 4, 0)], "child long, parent long, place int")
    start = spark.createDataFrame([(5,)], "src long")
    assert sorted(r["node"] for r in history.ancestors(edges, start).collect()) == [1, 2, 3, 4]
    pairs = spark.createDataFrame([(5, 6), (2, 3), (4, 5)], "a long, b long")
    assert {(r["a"], r["b"], r["ancestor"]) for r in history.common_ancestor(edges, pairs).collect()} == {(5, 6, 4), (2, 3, 1), (4, 5, 4)}
    assert [r["node"] for r in history.log(edges, start, 3).orderBy("depth").collect()] == [5, 4, 2]


def test_histogram_of_constant_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, x double")
    assert [(r["bin"], r["n"]) for r in stats.histogram(df, "g", 10).collect()] == [(5, 2)]


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r"))
    with pytest.raises(RepositoryError):
        repo.create_branch("x")
    first = repo.commit(model(spark, [("w", [1, 1]), ("b", [2])]), "first")
    repo.create_branch("side")
    second = repo.commit(model(spark, [("w", [3, 3]), ("b", [2])]), "second")
    repo.checkout("side")
    repo.commit(model(spark, [("w", [5, 5]), ("b", [2]), ("n", [7])]), "third")
    assert {(r["name"], r["state"]) for r in repo.diff(first, "side").collect()} == {("w", "modified"), ("n", "added")}
    with pytest.raises(MergeConflict):
        repo.merge("main", first, "fail")
    repo.merge("main", first, "weighted", 0.25)
    assert {r["name"]: r["values"] for r in repo.model("side").collect()} == {"w": [3.5, 3.5], "b": [2.0], "n": [7.0]}
    repo.tag("v1", "main")
    assert repo.manifest("v1").collect() == repo.manifest(second[:10]).collect()
    assert repo.collect_garbage().count() == 0
    assert repo.edges().count() == 4
    with pytest.raises(RepositoryError):
        repo.manifest("nothing")


def test_store_detects_wrong_hashes(spark, tmp_path):
    objects = store.ObjectStore(spark, str(tmp_path / "o"))
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "hash string, data string")
    objects.add(rows)
    objects.add(rows)
    assert objects.read().count() == 2
    with pytest.raises(store.IntegrityError):
        objects.load(rows.select("hash"), verify="data")


def test_tensor_files(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    np.savez(tmp_path / "two.npz", x=np.ones(2), y=np.zeros(1, np.int16))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    got = {r["name"]: r for r in tensors.read_numpy(spark, str(tmp_path)).collect()}
    assert got["one"]["shape"] == [2, 3] and got["one"]["values"] == [0, 1, 2, 3, 4, 5] and got["y"]["dtype"] == "int16" and got[None]["error"]
    header = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "h": {"dtype": "BF16", "shape": [1], "data_offsets": [8, 10]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + np.float32([1.5, -2]).tobytes() + b"\x80\x3f")
    rows = tensors.read_safetensors(spark, str(tmp_path))
    assert {r["name"]: r["values"] for r in rows.collect()} == {"w": [1.5, -2.0], "h": [1.0]}
    hashed = tensors.content_hash(tensors.read_numpy(spark, str(tmp_path)).filter("error is null"))
    assert hashed.select("hash").distinct().count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(r, s, float(rng.normal())) for r in range(3) for s in range(40)]
    for part in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 10 == part], "run long, seq long, loss double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run long, seq long, loss double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = training.early_stopping(stream).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = history.early_stopping(spark.createDataFrame(rows, "run long, seq long, loss double"))
    want = sorted((r["run"], r["seq"], r["is_best"], r["no_improve"], r["stop"]) for r in batch.collect())
    assert sorted(map(tuple, spark.table("stops").collect())) == want
