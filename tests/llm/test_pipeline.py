from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_op6 import brute as brute_spans
from test_op7 import brute as brute_groups

from weftline.llm import op1_quality, op6_secrets


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokenize"]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], sf_dir), f"t-{name}"))
        if name != "tokenize":
            assert out[-1].dtypes == docs.dtypes
    good = {r.doc_id for r in op1_quality.op1_quality(spark, sf_dir).collect() if r.predicted}
    one = out[1].collect()
    assert sorted(r.doc_id for r in one) == sorted(r.doc_id for r in start if r.doc_id in good)
    keep = {d for d, _, _, k in brute_groups([(r.doc_id, r.text) for r in one]) if k}
    two = out[2].collect()
    assert sorted(r.doc_id for r in two) == sorted(keep)
    three = {r.doc_id: r.text for r in out[3].collect()}
    assert three == {r.doc_id: op6_secrets.replace(r.text, op6_secrets.scan(r.text), "[secret]") for r in two}
    assert not any(brute_spans(t) for t in three.values())
    four = Counter(r.doc_id for r in out[4].collect())
    assert max(four.values()) <= 2 and set(four) <= set(three)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    five = out[5].collect()
    assert Counter(r.doc_id for r in five) == four
    assert all(list(r.ids) == library.encode(three[r.doc_id], add_eos=True) for r in five)
    # rows in order of position are the mix in order of its training positions
    mixed = {r.doc_id: r for r in corpus_pipeline.op5_mixing.mix(corpus_pipeline._keyed(out[3], "source"), "id").selectExpr("id.b as doc_id", "before", "source_size", "target", "slope").collect()}
    order, nth = [], Counter()
    for r in sorted(five, key=lambda r: r.position):
        m = mixed[r.doc_id]
        y = min(1.0, (m.before + m.source_size * nth[r.doc_id]) / m.target)
        b = 1 - m.slope
        order.append(min(1.0, 2 * y / (b + (b * b + 4 * m.slope * y) ** 0.5)))
        nth[r.doc_id] += 1
    assert order == sorted(order) and len({r.position for r in five}) == len(five)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, again)) == sorted(map(str, five))


def test_edge_rows(spark, sf_dir):
    rows = [(1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (None, "a b c d e f", None, None, None), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (3, "token=abcdefgh", "en", None, 1), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    two = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in two) == ["1", "2", "2", "3", "4"]
    assert {r.text for r in corpus_pipeline.secrets(spark, docs, sf_dir).collect()} == {"a b c d e f", None, "[secret]", ""}
    assert corpus_pipeline.mixing(spark, docs, sf_dir).count() > 0
    # columns whose names helpers might use pass through untouched
    more = docs.selectExpr("*", "1 as k", "2 as u", "3 as once", "4 as at", "5 as id", "6 as row", "7 as _k", "8 as c", "9 as size", "concat(text, repeat('long word ', 20000)) as extra")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        rows = stage(spark, more, sf_dir)
        assert rows.dtypes == more.dtypes
        assert {tuple(r)[5:14] for r in rows.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9)}
    assert corpus_pipeline.tokenize(spark, more.withColumn("text", F.col("extra")), sf_dir).agg(F.max("n_tokens")).first()[0] > 40_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
