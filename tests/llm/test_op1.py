import numpy as np
import pyarrow as pa

from weftline.llm import op1_quality as op1
from weftline.llm.fit import Isotonic


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op1.op1_quality(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [x for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 50
    assert sum(rows[x.doc_id].predicted == x.quality for x in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_isotonic_is_monotone_and_pools():
    rng = np.random.default_rng(0)
    raw = np.round(rng.normal(size=500), 1)
    label = (raw + rng.normal(size=500) > 0).astype(int)
    iso = Isotonic(raw, label)
    out = iso(np.linspace(-5, 5, 100))
    assert (np.diff(out) >= 0).all() and out.min() >= 0 and out.max() <= 1
    assert (Isotonic(np.array([1.0, 1.0]), np.array([0, 1]))(np.array([0.0, 1.0, 2.0])) == 0.5).all()


def test_features_approximate_gaussian_kernel():
    model = op1.Model(np.zeros(op1.N_STATS), np.ones(op1.N_STATS))
    x = np.random.default_rng(1).normal(size=(40, op1.N_STATS))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * op1.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.3 and np.abs(z @ z.T - want).mean() < 0.06


def test_statistics_of_edge_texts():
    s = op1.statistics(pa.array([None, "", " \n", "a", "a a a", "é|é", "x" * 100_000, "a b\nc"]))
    assert s.shape == (8, op1.N_STATS) and np.isfinite(s).all()
    assert (s[0] == s[1]).all() and s[4, 12] == 2 / 3 and s[4, 15] == 1


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 1.0), (None, None, 2.0), (1, "fine words here", 1.0), (2, "", 0.0), (3, "||| ||| |||", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    got = op1.score(docs, op1.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = op1.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in op1.score(docs, none).collect()} == {0.5}
    assert op1.score(docs.limit(0), none).count() == 0


def test_sample_is_bounded_in_rows(spark):
    """An id that is repeated many times, with equal and with other texts, counts once."""
    from weftline.llm.fit import labelled_sample

    docs = spark.range(3_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text ', cast(id % 50 as string)) as text")
    labels = spark.range(3_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows = labelled_sample(docs, labels, "quality", 200).collect()
    assert 100 < len(rows) <= 200 and len({r.id for r in rows}) == len(rows)
