import random
import re

import numpy as np

from weftline.llm import op7_minhash as op7


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """Component names by comparing all documents that share a shingle."""
    sets = [sets_of(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if 100 * n >= 70 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [(d, len(sets[i]), (names.get(find(i)) if sets[i] else d), d is not None and (not sets[i] or names[find(i)] == d)) for i, (d, _) in enumerate(docs)]


def key(row):
    return tuple(map(str, row))


def check(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = op7.group(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs), key=key)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op7.op7_minhash(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (None, "a b"), (None, "q"), (7, "a b c d e"), (7, "x y"), (8, "É É"), (9, "é é"), (10, "a b"), (11, "a " * 50_000)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op7.group(empty).count() == 0


def test_chains_hot_groups_and_shared_passages(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    docs, passage = [], [rng.choice(vocab) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(150):  # a walk of small edits: ends are far apart, neighbours near
        docs.append((1000 + rng.randrange(10_000_000), " ".join(base)))
        base[rng.randrange(len(base))] = rng.choice(vocab)
    for i in range(60):
        own = [rng.choice(vocab) for _ in range(rng.randrange(5, 100))]
        docs.append((i, " ".join(own + passage)))
    docs += [(500 + i, docs[0][1]) for i in range(80)]
    rng.shuffle(docs)
    check(spark, docs)


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 16, (200, op7.K)).astype(np.uint16)
    y = x.copy()
    most = op7.CHUNKS * (op7.ERRORS + 1) - 1
    for row in y:
        row[rng.permutation(op7.K)[:most]] ^= 1
    assert (op7.chunk_keys(x) == op7.chunk_keys(y)).any(axis=1).all()


def test_passage_shared_by_thousands(spark, monkeypatch):
    """One passage in 5,000 otherwise different documents, a few of which have a near copy that no hub finds for sure."""
    monkeypatch.setattr(op7, "BLOCK", 64)
    rng = np.random.default_rng(5)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 1_000_000, n)]
    passage = words(40)
    docs = [[*words(30), *passage, *words(30)] for _ in range(5_000)]
    near = [(i, [*docs[i][:-6], *words(6)]) for i in range(0, 5_000, 250)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(10_000 + i, " ".join(d)) for i, d in near]
    got = {r.doc_id: r.component_id for r in op7.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d - 10_000 if d >= 10_000 else d for d, _ in rows}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x", 7), (2, "a b c", 6, "y", 8)], "doc_id long, text string, node long, digest string, component long")
    assert sorted(map(tuple, op7.group(df).select("doc_id", "n_shingles", "component_id", "kept").collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_variants_of_one_text_around_the_threshold(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for group, many in enumerate((160, 40, 12, 5)):
        base = [rng.choice(vocab) for _ in range(150)]
        for i in range(many):  # edits leave 0.3 to 0.95 of the shingles; many variants link with nothing
            w = list(base)
            for _ in range(rng.randrange(1, 14)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((group * 1000 + i, " ".join(w)))
    for i in range(60):
        docs.append((9000 + i, " ".join(rng.choice(vocab) for _ in range(80))))
    rng.shuffle(docs)
    seen = {}

    def spy(name):
        real = getattr(op7, name)

        def call(*args):
            seen[name] = args, (out := op7.materialize(real(*args), "spied"))
            return out

        monkeypatch.setattr(op7, name, call)

    monkeypatch.setattr(op7, "BLOCK", 32)
    monkeypatch.setattr(op7, "SETS", 16)
    for name in ("_crossing", "_confirmed_in_blocks"):
        spy(name)
    check(spark, docs)
    found = [tuple(sorted((r.a, r.b))) for r in seen["_crossing"][1].collect()]
    assert len(found) > 500 and len(found) == len(set(found))  # each pair once, though it meets under many keys
    # the same groups as pair by pair, without a link for each similar pair
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = seen["_crossing"][1]
    plain = op7.components(op7._confirmed(pairs, df, "text", 70))
    links = op7._confirmed_in_blocks(pairs, df, "text", 70)
    assert sorted(map(tuple, op7.components(links).collect())) == sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(op7, "SETS", 256)
    few = op7._confirmed_in_blocks(pairs, df, "text", 70)
    assert sorted(map(tuple, op7.components(few).collect())) == sorted(map(tuple, plain.collect()))
