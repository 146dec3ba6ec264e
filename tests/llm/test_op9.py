import random

import pyarrow as pa

from weftline.llm import op9_toxicity as op9


def corpus(spark):
    plain = ["the and of thing walk river morning stone", "and the of water light under stone thing", "of walk the morning and river water light"]
    rows = [(i, f"{plain[i % 3]} number{i % 17} " * 4 + ("you stupidous zorgword fool" if i % 4 == 0 else "you see good day")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = op9.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = op9.score(docs, model).collect()
    assert sum((r.score >= op9.THRESHOLD) == bool(truth[r.doc_id]) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    # whole texts count: the same words after a long clean stretch
    clean = "the and of thing walk river " * 30_000
    a, b = model.score(pa.array([clean, clean + "zorgword stupidous zorgword fool"]))
    assert a < op9.THRESHOLD <= b


def test_query(spark, sf_dir):
    rows = op9.op9_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_edge_rows(spark):
    docs, labels = corpus(spark)
    extra = spark.createDataFrame([(None, None, 1), (900, "", 2), (901, " \n", 3), (901, " \n", 3)], "doc_id long, text string, score int")
    got = op9.score(extra, op9.fit(docs, labels)).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and got[0].score < op9.THRESHOLD
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        assert {r.score for r in op9.score(extra, op9.fit(docs, some)).collect()} == {0.0}
    assert op9.score(docs.limit(0), op9.fit(docs.limit(0), labels)).count() == 0


def test_held_out_fold_of_the_labels(spark):
    """On rows that nothing was learned from; some labels are wrong on purpose, so full recall can't be had."""
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in op9.op9_toxicity(spark, sf_dir).filter("held_out").collect() if r.doc_id in truth]
    toxic, clean = [p for p, t in got if t], [p for p, t in got if not t]
    assert len(toxic) >= 100 and len(clean) >= 800
    assert sum(toxic) >= 0.72 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_a_large_group_of_copies_hides_no_other_words(spark):
    rng = random.Random(4)
    vocab = "the and of thing walk river morning stone under water light".split()
    prose = lambda: " ".join(rng.choices(vocab, k=25))
    rows = [(i, f"{prose()} " + ("gromble zagfret" if i % 12 == 0 else "good day"), int(i % 12 == 0)) for i in range(900)]
    plain = prose()
    rows += [(1000 + i, plain + " vilest copied sentence of words", 1) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = op9.fit(docs, labels)
    found, clean = model.score(pa.array([f"{plain} gromble zagfret", f"{plain} good day"]))
    assert clean < op9.THRESHOLD <= found
