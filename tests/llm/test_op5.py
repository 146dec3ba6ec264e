import duckdb
import pytest

from weftline.llm import op5_mixing as op5


def compare(spark, sf_dir):
    got = sorted(map(tuple, op5.op5_mixing(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(op5.ORACLE_SQL).fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-12) and g[5] == pytest.approx(w[5], rel=1e-9)
    return got


def test_query_equals_sql(spark, sf_dir):
    rows = compare(spark, sf_dir)
    assert all(0 <= r[4] <= 2 * r[1] for r in rows)


def brute_targets(sizes, weights):
    goal, most = 1.5 * sum(sizes), [2 * s for s in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = goal
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level >= most[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = most[i]
            left -= most[i]
        open_ -= full
    return out


def test_targets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(3, "a"), (5, "a"), (100, "b"), (40, "c"), (60, "c"), (7, None), (0, None)])] + [(9, None, "d"), (0, "w w w", "a"), (None, "x", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", op5.F.lit(1))
    got = op5.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {"a": 11, "b": 100, "c": 100, "d": 0, "é": 1, None: 7}
    want = dict(zip(sizes, brute_targets(list(sizes.values()), [5, 2, 1] * 2), strict=True))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in own) == pytest.approx(want[s], abs=0.5)
    assert all(0 <= r.taken <= 2 * r.size and 0 <= r.position <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, op5.mix(df.repartition(3)).collect()))
    assert op5.mix(df.limit(0)).count() == 0


def test_position_inverts_demand(spark):
    for slope in (-0.5, 0.0, 0.5, 1.0, -1.0):
        for u in (0.0, 0.2, 0.7, 1.0):
            before = 1000 * (u + slope * (u * u - u))
            got = spark.range(1).select(op5.position(op5.F.lit(before), op5.F.lit(1000.0), op5.F.lit(slope))).first()[0]
            assert got == pytest.approx(u, abs=1e-7)


def test_very_long_texts_and_null_ids(spark):
    rows = [(None, f"word{i} " * 3, "a") for i in range(50)] + [(1, "long " * 300_000, "a"), (2, "x", "b")]
    got = op5.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.size for r in got if r.source == "a"} == {3, 300_000}
    own = [r for r in got if r.source == "a"]
    assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=0.5)
    assert len({r.before for r in own}) == len(own)  # every row has a place of its own
