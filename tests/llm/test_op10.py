from weftline.llm import op10_langid as op10


def test_query_is_right_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op10.op10_langid(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.rejected == (r.score < 0.5) for r in rows) and sum(r.rejected for r in held) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(1, "the one and the other thing", "en"), (3, "der eine und die andere sache", "de"), (4, None, "en"), (5, "", None), (6, "12 34 !!", "de"), (None, "und die sache", None), (1, "the one and the other thing", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op10.fit(df)
    got = {(r.doc_id, r.lang_pred) for r in op10.identify(df, model).collect()}
    assert got == {(1, "en"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (None, "de")}
    assert op10.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in op10.identify(df, op10.fit(df.limit(0))).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    df = spark.createDataFrame([(1, "the one and the other thing", "en"), (3, "der eine und die andere sache", "de"), (9, "zz", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in op10.identify(df, op10.fit(df), min_margin=0.02).collect()}
    assert got == {1: False, 3: False, 9: True}


def test_long_texts_ties_repeats_and_clashing_columns(spark):
    en, de = "the one and the other thing of it", "der eine und die andere sache von"
    rows = [(i, f"{en} {i}", "en", 1.0) for i in range(6)] + [(10 + i, f"{de} {i}", "de", 1.0) for i in range(4)]
    rows += [(100, f"{en} " * 40_000, None, 0.0), (101, "zzzz", "en", 0.0), (101, "zzzz", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = op10.fit(df.filter("doc_id < 100"))
    got = op10.identify(df, model).collect()
    assert [r.lang_pred for r in got if r.doc_id == 100] == ["en"]
    assert {(r.lang_pred, r.rejected) for r in got if r.doc_id == 101} == {("en", True)}  # nothing to tell: the language with more rows


def test_sample_is_bounded_by_rows(spark):
    """A third of all rows copies of one text: they count once, and other texts of the language are found."""
    from weftline.llm.common import sample_texts

    df = spark.range(30_000).selectExpr("id % 1000 as doc_id", "'a' as lang", "if(id % 3 = 0, 'same', concat('text ', cast(id as string))) as text")
    got = sample_texts(df, "lang", "text", {"a": 30_000}, 50, 100)["a"]
    assert len(got) == len(set(got)) == 50
    same = spark.range(5_000).selectExpr("'b' as lang", "'same' as text")
    assert sample_texts(same, "lang", "text", {"b": 5_000}, 50, 100) == {"b": ["same"]}
