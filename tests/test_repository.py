import numpy as np
import pytest

from weftline import cli, config
from weftline.operators import codec, dedup, deltas, index, merge, remotes, runs, store
from weftline.operators.repository import MergeConflict, Repository, RepositoryError, clone
from weftline.sources import tensors


def model(spark, rows):
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in rows], "name string, values array<double>")


def values(df):
    return {r["name"]: list(r["values"]) for r in df.collect()}


@pytest.fixture
def diverged(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r"), init=True)
    repo.commit(model(spark, [("shared", [5] * 4), ("same", [1])]), "base")
    repo.create_branch("side")
    repo.commit(model(spark, [("shared", [20] * 4), ("same", [1])]), "ours")
    repo.checkout("side")
    repo.commit(model(spark, [("shared", [10] * 4), ("same", [1]), ("new", [7])]), "theirs")
    repo.checkout("main")
    return repo


@pytest.mark.parametrize("strategy, shared", [("ours", 20), ("theirs", 10), ("average", 15), ("weighted", 17.5)])
def test_merge_strategies_find_the_ancestor(diverged, strategy, shared):
    head = diverged.merge("side", strategy=strategy, alpha=0.75)
    assert values(diverged.model("main")) == {"shared": [shared] * 4, "same": [1.0], "new": [7.0]}
    parents = diverged.commits().filter(f"commit = '{head}'").first()["parents"]
    assert len(parents) == 2


def test_merge_refusals_fast_forward_and_soup(diverged, spark):
    with pytest.raises(RepositoryError):
        diverged.merge("side", strategy="nonsense")
    with pytest.raises(MergeConflict) as e:
        diverged.merge("side", strategy="fail")
    assert e.value.names == ["shared"]
    diverged.create_branch("twin")
    with pytest.raises(RepositoryError):
        diverged.merge("twin")
    before = diverged.head()
    diverged.checkout("twin")
    ahead = diverged.commit(model(spark, [("shared", [1] * 4)]), "ahead")
    diverged.checkout("main")
    assert diverged.merge("twin") == ahead and diverged.head() == ahead  # moved, no new commit
    diverged.checkout("twin")
    diverged.move_branch("main", before)
    assert diverged.merge("main") == ahead  # already in
    diverged.checkout("main")
    diverged.merge("side", strategy="soup", config=merge.SoupConfig())
    assert values(diverged.model("main")) == {"shared": [15.0] * 4, "same": [1.0], "new": [7.0]}


def test_references_staging_and_detached_heads(diverged, spark, tmp_path):
    with pytest.raises(RepositoryError):
        Repository(spark, diverged.path, init=True)
    with pytest.raises(RepositoryError):
        Repository(spark, str(tmp_path / "no"), init=False)
    version = diverged.tag("v1", "side", "first release", {"loss": 0.5})
    row = diverged.versions().first()
    assert row["version_id"] == version and row["metrics"] == {"loss": 0.5} and diverged.resolve("v1") == diverged.resolve("side")
    assert {r["name"]: r["current"] for r in diverged.branches().collect()} == {"main": True, "side": False}
    assert [r["message"] for r in diverged.log().collect()] == ["ours", "base"]
    diverged.checkout(diverged.head()[:12])
    with pytest.raises(RepositoryError):
        diverged.commit(model(spark, [("w", [1])]), "nowhere")
    diverged.checkout("main")
    with pytest.raises(RepositoryError):
        diverged.commit_staged("nothing there")
    a = np.linspace(-1, 1, 64)
    staged = diverged.stage(model(spark, [("a", a), ("b", a), ("c", a * 1.001), ("d", -a)]))
    assert {(r["name"], r["kind"], r["ref"]) for r in staged.collect()} == {("a", "unique", "a"), ("b", "duplicate", "a"), ("c", "similar", "a"), ("d", "unique", "d")}
    diverged.commit_staged("staged", tags=("x",))
    assert set(values(diverged.model("main"))) == {"a", "b", "c", "d"} and diverged.staged() is None
    assert diverged.weight("d", "main") == (-a).tolist() and diverged.weight("zz", "main") is None


@pytest.mark.parametrize("kind", ["xor_float32", "xor_bfloat16"])
def test_commits_as_deltas_come_back_bit_by_bit(spark, tmp_path, kind):
    rng = np.random.default_rng(12345)
    w = rng.normal(size=1500).astype(np.float32)
    near = (w + np.float32(0.01) * rng.normal(size=1500).astype(np.float32)).astype(np.float32)
    repo = Repository(spark, str(tmp_path / "r"), delta_kind=kind)
    repo.commit(model(spark, [("w", w), ("tiny", [1, 2, 3])]), "one")
    repo.commit(model(spark, [("w", near), ("tiny", [4, 5, 6])]), "two")
    assert values(repo.model("main")) == {"w": near.astype(float).tolist(), "tiny": [4.0, 5.0, 6.0]}
    assert {r["name"]: r["encoded"] for r in deltas.delta_of(repo.manifest("main"), repo.manifest("main")).collect()} == {"w": True, "tiny": False}
    assert repo._stored().count() == 3 and repo.deltas.table().count() == 1
    assert repo.collect_garbage(True).count() == 0 and set(values(repo.model("main"))) == {"w", "tiny"}
    assert all(r["intact"] for r in deltas.reconstructed(repo.manifest("main"), repo._stored(), repo.deltas.table(), strict=True).collect())


def test_clone_push_pull(diverged, spark, tmp_path):
    other = clone(spark, diverged.path, str(tmp_path / "c"))
    assert values(other.model("side")) == values(diverged.model("side")) and other.log("side").count() == 2
    assert diverged.sync_status(other.path).first()["is_synced"]
    other.commit(model(spark, [("shared", [3] * 4)]), "more")
    assert [tuple(r) for r in diverged.pull(other.path).collect()] == [("push", 1, 32, 0, True)]
    assert values(diverged.model("main")) == {"shared": [3.0] * 4}
    assert diverged.push(other.path).count() == 0
    known = remotes.Remotes(spark, str(tmp_path / "remotes"))
    known.add("origin", "minio://host/bucket/x")
    assert known.get("origin")["kind"] == "s3" and known.get("origin")["bucket"] == "bucket"
    for bad in (lambda: known.add("origin", "s3://b"), lambda: known.add("x", "ftp://b"), lambda: known.remove("y")):
        with pytest.raises(ValueError):
            bad()
    known.remove("origin")
    assert known.list().count() == 0


@pytest.mark.parametrize("kind", codec.KINDS)
def test_every_codec_gives_back_what_it_can(spark, kind):
    rng = np.random.default_rng(3)
    a, d = rng.normal(size=96).astype(np.float32), np.where(np.arange(96) % 5 == 0, 0, 0.01 * rng.normal(size=96)).astype(np.float32)
    b = a + d
    rows = spark.createDataFrame([("w", a.tolist(), b.tolist()), ("zero", [0.0], [0.0]), ("other", [1.0], [1.0, 2.0])], "name string, va array<double>, vb array<double>")
    got = {r["name"]: r for r in codec.decode(codec.encode(rows, kind, 8).withColumn("kind", codec.F.lit(kind))).collect()}
    assert got["other"]["data"] is None and got["zero"]["restored"] == [0.0]
    error = np.abs(np.array(got["w"]["restored"]) - b).max()
    most = {"int8": np.ptp(d) / 255, "int16": np.ptp(d) / 65535, "per_axis": 0.1, "sparse": 2e-6}.get(kind, 1e-7)
    assert error <= most and (kind not in codec.LOSSLESS or (np.array(got["w"]["restored"], np.float32) == b).all())


def test_store_lookups_deletes_and_modes(spark, tmp_path):
    path = str(tmp_path / "o")
    objects = store.ObjectStore(spark, path)
    rows = spark.createDataFrame([("a", 10, 5, [1.0]), ("b", 20, 9, [2.0]), ("c", 30, 9, [3.0])], "hash string, raw_bytes long, stored_bytes long, values array<double>")
    assert objects.list().count() == 0
    objects.add(rows)
    ask = spark.createDataFrame([("a",), ("z",)], "hash string")
    assert {(r["hash"], r["found"]) for r in objects.exists(ask).collect()} == {("a", True), ("z", False)}
    assert "values" not in objects.metadata().columns and objects.metadata(ask).count() == 1
    assert [len(b) for b in objects.batches(size=2)] == [2, 1] and [len(b) for b in objects.batches(ask)] == [1]
    objects.delete(ask)
    assert {r["hash"] for r in objects.list().collect()} == {"b", "c"} and objects.info().first()["raw_bytes"] == 50
    with pytest.raises(PermissionError):
        store.ObjectStore(spark, path, "r").add(rows)
    for bad in ({"mode": "q"}, {"compression": "szip"}):
        with pytest.raises(ValueError):
            store.ObjectStore(spark, path, **bad)
    hashed = spark.createDataFrame([("x", "data", "w")], "hash string, data string, name string")
    texts = store.ObjectStore(spark, str(tmp_path / "t"))
    texts.add(hashed)
    with pytest.raises(store.IntegrityError) as e:
        texts.load(hashed.select("hash"), "data")
    assert e.value.expected == "x" and len(e.value.actual) == 64 and e.value.name == "w"
    assert [r["intact"] for r in texts.load(hashed.select("hash"), "data", strict=False).collect()] == [False]


def test_stores_by_url_and_copies(spark, tmp_path):
    a, b = store.open_store(spark, f"file://{tmp_path}/a"), store.open_store(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("z", 3, 1)], "hash string, raw_bytes long, stored_bytes long")
    a.add(rows)
    assert store.copied(a, b, rows.filter("hash = 'x'")) == {"copied": 1, "skipped": 0}
    assert store.copied(a, b) == {"copied": 2, "skipped": 1} and b.info().first()["raw_bytes"] == 6
    assert store.open_store(spark, "s3://bucket/x").path == "s3a://bucket/x" and store.open_store(spark, "minio://h:9000/bucket/x").path == "s3a://bucket/x"
    with pytest.raises(ValueError):
        store.open_store(spark, "ftp://x")


def test_indexes_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 32))
    x[1] = x[0] + 0.01 * rng.normal(size=32)
    tensors_ = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(99, [1.0, 2.0])], "name long, values array<double>")
    bits = (x @ dedup.planes(32, 128).T > 0).astype(np.uint8)
    assert (index.unpacked(index.packed(bits), 128) == bits).all()
    table = index.fingerprints(tensors_, 128).persist()
    got = {(r["query"], r["id"]): r["distance"] for r in index.scan(table, table.filter("id < 3"), 40).collect()}
    want = {(q, i): int((bits[q] != bits[i]).sum()) for q in range(3) for i in range(60) if i != q and (bits[q] != bits[i]).sum() <= 40}
    assert got == want and (0, 1) in got
    slots = index.slots(tensors_, 6, 4)
    s = (x @ dedup.planes(32, 24).T > 0).reshape(60, 6, 4) @ (1 << np.arange(3, -1, -1))
    found = {(r["query"], r["id"]): r["tables"] for r in index.bucket_candidates(slots, slots.filter("id = 0")).collect()}
    assert found == {(0, i): int((s[0] == s[i]).sum()) for i in range(1, 60) if (s[0] == s[i]).any()}
    stats = {r["dim"]: r for r in index.bucket_stats(slots).collect()}
    assert stats[32]["vectors"] == 60 and stats[32]["buckets"] == sum(len(set(s[:, t])) for t in range(6)) and stats[2]["vectors"] == 1
    assert index.cleared(table).count() == 0 and index.removed(table, table.filter("id = 1")).count() == 60


def test_soup_dispatch_and_refusals(spark):
    cell = lambda x: spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(x)], "name string, pos int, x double")
    out = lambda df: [r["x"] for r in df.orderBy("pos").collect()]
    base, a, b = cell([0, 0, 0]), cell([1, 2, -1]), cell([3, -2, -1])
    assert out(merge.soup([a])) == [1, 2, -1] and out(merge.uniform_soup([a, b])) == [2, 0, -1]
    assert out(merge.soup([a, b], merge.SoupConfig("weighted", (3.0, 1.0)))) == [1.5, 1, -1]
    assert out(merge.soup([a, b], merge.SoupConfig("ties", density=1.0), base)) == [2, 2, -1]
    assert out(merge.soup([a, b], merge.SoupConfig("dare_ties", drop=0.0, density=1.0), base)) == [2, 2, -1]
    assert out(merge.soup([a, b], merge.SoupConfig("dare_linear", drop=1.0), base)) == [0, 0, 0]
    assert out(merge.soup([a, b], merge.SoupConfig("task", scale=0.5), base)) == [2, 0, -1]
    score = lambda m: -abs(out(m)[0] - 2)
    assert out(merge.soup([a, b], merge.SoupConfig("greedy"), score=score))[0] == 2
    for bad in (lambda: merge.soup([]), lambda: merge.soup([a, b], merge.SoupConfig("ties")), lambda: merge.SoupConfig("magic"), lambda: merge.SoupConfig(drop=2.0), lambda: merge.soup([a, b], merge.SoupConfig("weighted"))):
        with pytest.raises(ValueError):
            bad()


def test_runs_and_publishing(spark, tmp_path):
    known = runs.RunStore(spark, str(tmp_path / "runs"))
    known.start("r1")
    known.log_metrics("r1", {"loss": 0.5}, 1)
    known.log_metrics("r1", {"loss": 0.25}, 2)
    known.log_params("r1", {"lr": 0.1})
    known.link("r1", "c1")
    known.link("r1", "c2")
    known.end("r1")
    known.publish("p1", "m", "c2", "local", True, 3)
    asked = spark.createDataFrame([("r1",), ("r2",)], "run string")
    assert [tuple(r) for r in runs.commit_of_run(known.table("links"), asked).collect()] == [("r1", "c2")]
    assert known.info().first()["status"] == "finished" and runs.run_summary(known.table("metrics")).first()["last"] == 0.25
    assert [r["run"] for r in runs.unlinked(known.table("links"), asked).collect()] == ["r2"]
    assert runs.newest_publish(known.table("publishes")).first()["id"] == "p1" and "# m" in runs.model_card(known.table("publishes")).first()["card"]
    made = model(spark, [("w", [1, 2]), ("b", [3])])
    for kind, read in (("npz", tensors.read_numpy), ("safetensors", tensors.read_safetensors)):
        assert tensors.publish(made, str(tmp_path / kind), kind)[-1].endswith("metadata.json")
        assert values(read(spark, str(tmp_path / kind))) == {"w": [1.0, 2.0], "b": [3.0]}
    with pytest.raises(ValueError):
        tensors.publish(made, str(tmp_path / "x"), "pickle")


def test_settings(tmp_path):
    (tmp_path / "user.toml").write_text('[user]\nname = "a"\n[core]\nthreshold = 0.95\n')
    (tmp_path / "config.toml").write_text("[core]\nthreshold = 0.97\n[delta]\nstrict = true\n")
    s = config.load(str(tmp_path), str(tmp_path / "user.toml"), {"WEFTLINE_INDEX__BITS": "128", "WEFTLINE_CORE__NEAR_DEDUP": "0"})
    assert (s.user.name, s.core.threshold, s.delta.strict, s.index.bits, s.core.near_dedup) == ("a", 0.97, True, 128, False)
    config.save(s, str(tmp_path / "again" / "config.toml"))
    assert config.load(str(tmp_path / "again"), str(tmp_path / "none"), {}) == s
    with pytest.raises(ValueError):
        config.load(None, str(tmp_path / "none"), {"WEFTLINE_CORE__THRESHOLD": "2"})
    with pytest.raises(KeyError):
        config.set_nested(s, "core.nothing", 1)
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.validate(config.Settings())[1] == ["user.name isn't set; commits have no author"]


def test_command_line(spark, tmp_path):
    path, lines = str(tmp_path / "r"), []
    call = lambda *argv: cli.run(spark, ["--repo", path, *argv], lines.append)
    np.savez(tmp_path / "m.npz", w=np.ones(4), v=np.zeros(2))
    np.savez(tmp_path / "n.npz", w=np.ones(4) * 2, v=np.zeros(2))
    assert call("log") == 1 and call("init") == 0 and call("init") == 1
    assert call("add", str(tmp_path / "m.npz")) == 0 and call("commit", "--message", "one", "--author", "me") == 0
    assert call("branch", "side") == 0 and call("checkout", "side") == 0
    assert call("add", str(tmp_path / "n.npz")) == 0 and call("commit", "--message", "two") == 0
    lines.clear()
    assert call("diff", "main", "side") == 0 and lines == ["modified  w"]
    for argv in (("compare", "main", "side"), ("tag", "v1"), ("show", "w"), ("gc",), ("stats",), ("status",), ("log",), ("remote", "add", "o", f"file://{tmp_path}/o"), ("push", "o"), ("sync-status", "o"), ("config", "core.threshold", "0.9"), ("publish", "side", str(tmp_path / "out")), ("checkout", "main"), ("merge", "side")):
        assert call(*argv) == 0, (argv, lines)
    assert call("config", "core.threshold", "7") == 1 and call("show", "w", "--ref", "nowhere") == 1
    lines.clear()
    assert call("log") == 0 and [x.rsplit(" ", 1)[1] for x in lines] == ["two", "one"]
