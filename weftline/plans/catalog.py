"""Registered queries of the tensor-versioning operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.functions import text as X
from weftline.operators import codec, compare, dedup, history, merge, stats, store
from weftline.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    from weftline.plans import extended  # noqa: F401  registers its own on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def r6(name: str) -> Column:
    return (F.round(F.col(name), 6) + 0.0).alias(name)


def _models(spark, sf):
    return V.base_model(spark, sf), V.tuned_model(spark, sf)


def _cells(spark, sf):
    return [V.elements(m) for m in _models(spark, sf)]


def _pairs(spark, sf):
    a, b = _models(spark, sf)
    return a.select("name", F.col("values").alias("va")).join(b.select("name", F.col("values").alias("vb")), "name")


# --- comparing

_COMPARED = f"""
WITH {V.MODELS_SQL},
j AS (SELECT coalesce(b.name, f.name) AS name, b.v AS va, f.v AS vb FROM base b FULL OUTER JOIN ft f ON b.name = f.name),
n AS (SELECT *, sqrt(list_dot_product(va, va)) AS na, sqrt(list_dot_product(vb, vb)) AS nb, list_dot_product(va, vb) AS ab,
  list_transform(list_zip(vb, va), lambda p: p[1] - p[2]) AS d FROM j),
c AS (SELECT name, CASE WHEN vb IS NULL THEN 'only_a' WHEN va IS NULL THEN 'only_b' ELSE 'both' END AS status,
  CASE WHEN vb IS NULL OR va IS NULL THEN NULL WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE ab / (na * nb) END AS cos,
  CASE WHEN vb IS NULL OR va IS NULL THEN NULL WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE least(na, nb) / greatest(na, nb) END AS mag,
  CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN d END AS d, len(va) AS n FROM n),
compared AS (SELECT name, status, cos, mag, 0.7 * (cos + 1) / 2 + 0.3 * mag AS similarity, list_sum(d) / n AS mean_delta,
  list_sum(list_transform(d, lambda x: abs(x))) / n AS mean_abs_delta, list_max(list_transform(d, lambda x: abs(x))) AS max_abs_delta,
  sqrt(list_sum(list_transform(d, lambda x: x * x)) / n) AS rmse, len(list_filter(d, lambda x: abs(x) > 1e-6))::BIGINT AS changed,
  CASE WHEN status = 'both' THEN n END::BIGINT AS params FROM c)
"""
_FLOATS = ("cos", "mag", "similarity", "mean_delta", "mean_abs_delta", "max_abs_delta", "rmse")


@query(_COMPARED + f"SELECT name, status, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _FLOATS)}, changed, params FROM compared")
def model_compare(spark, sf):
    return compare.compare_models(*_models(spark, sf)).select("name", "status", *(r6(c) for c in _FLOATS), "changed", "params")


@query(_COMPARED + """SELECT count(*) FILTER (status = 'both') AS common, count(*) FILTER (status = 'only_a') AS only_a, count(*) FILTER (status = 'only_b') AS only_b,
  sum(params)::BIGINT AS params, sum(changed) FILTER (status = 'both')::BIGINT AS changed, round(avg(similarity), 6) AS mean_similarity, round(min(similarity), 6) AS min_similarity,
  round(max(similarity), 6) AS max_similarity FROM compared""")
def compare_summary(spark, sf):
    out = compare.summary(compare.compare_models(*_models(spark, sf)))
    return out.select("common", "only_a", "only_b", "params", "changed", r6("mean_similarity"), r6("min_similarity"), r6("max_similarity"))


@query(_COMPARED + """, k AS (SELECT CASE WHEN similarity >= 0.9999 THEN 'identical' WHEN similarity >= 0.99 THEN 'minor' WHEN similarity >= 0.9 THEN 'moderate' ELSE 'major' END AS category FROM compared WHERE similarity IS NOT NULL)
  SELECT c.category, count(k.category) AS layers FROM (VALUES ('identical'), ('minor'), ('moderate'), ('major')) c(category) LEFT JOIN k ON c.category = k.category GROUP BY c.category""")
def compare_categories(spark, sf):
    return compare.categories(compare.compare_models(*_models(spark, sf)))


@query(_COMPARED + "SELECT name, round(similarity, 6) AS similarity FROM compared WHERE similarity IS NOT NULL ORDER BY round(similarity, 9), name LIMIT 10")
def most_changed_layers(spark, sf):
    out = compare.compare_models(*_models(spark, sf)).withColumn("exact", F.col("similarity")).withColumn("similarity", F.round("exact", 9))
    return compare.most_changed(out).select("name", F.round("exact", 6).alias("similarity"))


@query(f"""WITH {V.MODELS_SQL} SELECT name, round(avg(abs(b.x - f.x) / (abs(b.x) + abs(f.x) + 1e-10)), 6) AS mean_relative, round(max(abs(b.x - f.x) / (abs(b.x) + abs(f.x) + 1e-10)), 6) AS max_relative,
  round(sqrt(avg((b.x - f.x) * (b.x - f.x))), 6) AS rmse FROM bx b JOIN fx f USING (name, pos) GROUP BY name""")
def relative_difference(spark, sf):
    return compare.relative_difference(*_models(spark, sf)).select("name", r6("mean_relative"), r6("max_relative"), r6("rmse"))


@query(_COMPARED + "SELECT name, cos >= 0.99 AS is_similar, cos >= 0.99 AND mag >= 0.9 AS are_similar, cos >= 0.98 AND mag >= 0.9 AND similarity > 0.98 AS matches FROM compared WHERE status = 'both'")
def similarity_tests(spark, sf):
    pair = _pairs(spark, sf).withColumns({"cos": S.cosine(F.col("va"), F.col("vb")), "mag": S.magnitude(F.col("va"), F.col("vb"))})
    return pair.select("name", (F.col("cos") >= 0.99).alias("is_similar"), ((F.col("cos") >= 0.99) & (F.col("mag") >= 0.9)).alias("are_similar"), S.matches(F.col("cos"), F.col("mag"), 0.98).alias("matches"))


@query(f"""WITH {V.MODELS_SQL}, j AS (SELECT coalesce(b.name, f.name) AS name, b.v AS va, f.v AS vb FROM base b FULL OUTER JOIN ft f ON b.name = f.name),
  s AS (SELECT name, va, vb, CASE WHEN va IS NULL THEN 'added' WHEN vb IS NULL THEN 'removed' WHEN len(list_filter(list_zip(va, vb), lambda p: abs(p[1] - p[2]) > 1e-7 + 1e-5 * abs(p[2]))) = 0 THEN 'unchanged' ELSE 'changed' END AS state FROM j)
  SELECT name, state, CASE WHEN state = 'changed' THEN round(list_dot_product(va, vb) / sqrt(list_dot_product(va, va)) / sqrt(list_dot_product(vb, vb)), 6) END AS similarity FROM s""")
def checkpoint_diff(spark, sf):
    return compare.diff_values(*_models(spark, sf)).select("name", "state", r6("similarity"))


# --- manifests

_M = f"WITH {V.MANIFEST_SQL} "


def _manifests(spark, sf):
    return [V.manifest(spark, sf, v) for v in range(3)]


@query(_M + """SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'modified' END AS state, a.hash AS h0, b.hash AS h1
  FROM m0 a FULL OUTER JOIN m1 b ON a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash""")
def manifest_diff(spark, sf):
    old, new, _ = _manifests(spark, sf)
    return compare.diff(old, new)


@query(_M + "SELECT name, hash FROM m1 WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.name = m1.name AND m0.hash = m1.hash)")
def changed_weights(spark, sf):
    old, new, _ = _manifests(spark, sf)
    return compare.changed_weights(old, new)


@query(_M + "SELECT name, 'added' AS state FROM m1 WHERE name NOT IN (SELECT name FROM m0) UNION ALL SELECT name, 'removed' FROM m0 WHERE name NOT IN (SELECT name FROM m1)")
def added_and_removed(spark, sf):
    old, new, _ = _manifests(spark, sf)
    return compare.added_names(old, new).withColumn("state", F.lit("added")).unionByName(compare.added_names(new, old).withColumn("state", F.lit("removed")))


@query(_M + "SELECT name FROM m1 INTERSECT SELECT name FROM m2")
def common_layers(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return compare.common_names(ours, theirs)


@query(_M + """, r AS (SELECT coalesce(o.name, t.name, b.name) AS name, o.hash AS o, t.hash AS t, b.hash AS b FROM m1 o FULL OUTER JOIN m2 t ON o.name = t.name FULL OUTER JOIN m0 b ON b.name = coalesce(o.name, t.name)),
  s AS (SELECT name, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o ELSE coalesce(o, t) END AS hash,
    o IS DISTINCT FROM t AND o IS DISTINCT FROM b AND t IS DISTINCT FROM b AS conflict FROM r) SELECT * FROM s WHERE hash IS NOT NULL""")
def three_way_merge(spark, sf):
    return compare.three_way(*_manifests(spark, sf))


@query(_M + "SELECT (SELECT count(DISTINCT hash) FROM m1 WHERE hash NOT IN (SELECT hash FROM m2)) AS ahead, (SELECT count(DISTINCT hash) FROM m2 WHERE hash NOT IN (SELECT hash FROM m1)) AS behind, (SELECT count(*) FROM (SELECT hash FROM m1 INTERSECT SELECT hash FROM m2)) AS synced, NOT EXISTS (SELECT 1 FROM m1 WHERE hash NOT IN (SELECT hash FROM m2)) AND NOT EXISTS (SELECT 1 FROM m2 WHERE hash NOT IN (SELECT hash FROM m1)) AS is_synced")
def sync_status(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return store.sync_status(ours, theirs)


@query(_M + "SELECT DISTINCT hash FROM m1 WHERE hash NOT IN (SELECT hash FROM m2)")
def push_set(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return store.to_push(ours.select("hash").distinct(), theirs)


@query(_M + "SELECT DISTINCT l_orderkey AS hash FROM lineitem WHERE l_orderkey NOT IN (SELECT hash FROM m0 UNION ALL SELECT hash FROM m1 UNION ALL SELECT hash FROM m2)")
def garbage_objects(spark, sf):
    objects = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hash")).distinct()
    return store.garbage(objects, *_manifests(spark, sf))


@query(_M + "SELECT DISTINCT commit FROM (SELECT 'm0' AS commit, hash FROM m0 UNION ALL SELECT 'm1', hash FROM m1 UNION ALL SELECT 'm2', hash FROM m2) WHERE hash IN (SELECT min(hash) FROM m1)")
def commits_with_weight(spark, sf):
    all_ = _manifests(spark, sf)
    rows = [m.withColumn("commit", F.lit(f"m{i}")) for i, m in enumerate(all_)]
    return store.referring(rows[0].unionByName(rows[1]).unionByName(rows[2]), all_[1].agg(F.min("hash").alias("hash")))


@query("SELECT o_orderkey AS hash, min(o_custkey) AS raw_bytes FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def insert_if_absent(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("raw_bytes"))
    return store.absent(rows, V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("hash")))


@query("SELECT count(*) AS objects, sum(n_chars)::BIGINT AS raw_bytes, sum(n_chars // 2)::BIGINT AS stored_bytes, round(1 - sum(n_chars // 2) / sum(n_chars), 6) AS ratio FROM documents")
def storage_info(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("hash"), F.col("n_chars").alias("raw_bytes"), F.floor(F.col("n_chars") / 2).cast("long").alias("stored_bytes"))
    return store.info(rows).select("objects", "raw_bytes", "stored_bytes", r6("ratio"))


@query("SELECT 'layer.' || l_linenumber AS name, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1 UNION ALL SELECT CASE l_linenumber WHEN 1 THEN 'head' ELSE 'stem' END, count(*) FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1")
def renamed_keys(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("string").alias("name"))
    return store.renamed(rows, {"1": "head", "2": "stem"}, "layer.").groupBy("name").agg(F.count("name").alias("n"))


@query("SELECT sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def estimated_memory(spark, sf):
    return stats.memory(V.base_model(spark, sf))


# --- deduplication

_DUP = "WITH named AS (SELECT doc_id, sha256(text) AS hash, n_chars AS bytes FROM documents), refs AS (SELECT hash, min(doc_id) AS first, count(*) AS copies FROM named GROUP BY hash), asg AS (SELECT doc_id, first, CASE WHEN doc_id = first THEN 'unique' ELSE 'duplicate' END AS kind, bytes FROM named JOIN refs USING (hash)) "


def _assigned(spark, sf):
    docs = V.table(spark, sf, "documents")
    return dedup.exact_assignment(docs, "doc_id", "text"), docs.select("doc_id", F.col("n_chars").alias("bytes"))


@query(_DUP + "SELECT * FROM refs")
def exact_dedup(spark, sf):
    return dedup.exact(V.table(spark, sf, "documents"), "doc_id", "text")


@query(_DUP + "SELECT doc_id, first, kind FROM asg")
def exact_assignment(spark, sf):
    return _assigned(spark, sf)[0]


@query(_DUP + "SELECT count(*) AS total, count(*) FILTER (kind = 'unique') AS unique_rows, count(*) FILTER (kind <> 'unique') AS duplicates, sum(bytes)::BIGINT AS original_bytes, sum(bytes) FILTER (kind = 'unique')::BIGINT AS stored_bytes, sum(bytes) FILTER (kind <> 'unique')::BIGINT AS saved_bytes, round(sum(bytes) FILTER (kind <> 'unique') / sum(bytes), 6) AS saved_share FROM asg")
def dedup_report(spark, sf):
    out = dedup.savings(*_assigned(spark, sf), "doc_id")
    return out.select("total", "unique_rows", "duplicates", "original_bytes", "stored_bytes", F.col("saved_bytes").cast("long").alias("saved_bytes"), r6("saved_share"))


@query(_DUP + "SELECT first, count(*) AS copies, sum(bytes)::BIGINT AS saved FROM asg WHERE kind <> 'unique' GROUP BY first ORDER BY saved DESC, first LIMIT 10")
def largest_groups(spark, sf):
    return dedup.largest_groups(*_assigned(spark, sf), "doc_id")


def _library(spark, sf):
    """Base tensors and tuned ones after them."""
    a, b = _models(spark, sf)
    return a.select("name", "values").unionByName(b.select((F.col("name") + 10_000_000).alias("name"), "values"))


@query()
def lsh_candidates(spark, sf):
    return dedup.top_candidates(dedup.near_pairs(dedup.fingerprint(_library(spark, sf))))


@query()
def lsh_index_stats(spark, sf):
    return dedup.index_stats(dedup.fingerprint(_library(spark, sf)))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey * 2654435761))::INT AS distance, round(cos(pi() * bit_count(xor(o_orderkey, o_custkey * 2654435761)) / 64), 6) AS estimated, (o_orderkey >> 4) & 65535 AS slot FROM orders")
def fingerprint_distance(spark, sf):
    a, b = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long") * F.lit(2654435761)
    rows = V.table(spark, sf, "orders").withColumn("distance", S.hamming(a, b))
    return rows.select("o_orderkey", "distance", F.round(S.estimated_cosine(F.col("distance")), 6).alias("estimated"), F.shiftrightunsigned(a, 4).bitwiseAND(F.lit(65535)).alias("slot"))


# --- merging

_W = f"WITH {V.MODELS_SQL}"
_TASK = _W + ", t AS (SELECT 0 AS model, f.name, f.pos, f.x - b.x AS x FROM fx f JOIN bx b USING (name, pos) UNION ALL SELECT 1, name, pos, (x * 0.5 + 0.01 * (pos % 3)) - x FROM bx)"


def _two(spark, sf):
    """Two models on one base: the tuned one, and the base shrunk with a pattern added."""
    base, tuned = _cells(spark, sf)
    return base, [tuned, base.withColumn("x", F.col("x") * 0.5 + 0.01 * (F.col("pos") % 3))]


@query(_W + ", u AS (SELECT name, pos, x, 1.0 AS w FROM bx UNION ALL SELECT name, pos, x, 3.0 FROM fx) SELECT name, pos, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM u GROUP BY name, pos")
def weighted_soup(spark, sf):
    return merge.weighted_soup(_cells(spark, sf), [1.0, 3.0]).select("name", "pos", r6("x"))


@query(_W + "SELECT name, pos, round(CASE WHEN f.x IS NULL THEN b.x ELSE 0.3 * b.x + (1 - 0.3) * f.x END, 6) + 0.0 AS x FROM bx b LEFT JOIN fx f USING (name, pos)")
def merge_weighted(spark, sf):
    return merge.interpolate(*_cells(spark, sf), 0.3).select("name", "pos", r6("x"))


@query(_TASK + "SELECT name, pos, round(x, 6) + 0.0 AS x FROM t WHERE model = 0")
def task_vectors(spark, sf):
    base, models = _two(spark, sf)
    return merge.task_vectors(models[0], base).select("name", "pos", r6("x"))


@query(_TASK + "SELECT name, pos, round(any_value(b.x) + 0.4 * sum(t.x), 6) + 0.0 AS x FROM t JOIN bx b USING (name, pos) GROUP BY name, pos")
def task_arithmetic(spark, sf):
    base, models = _two(spark, sf)
    return merge.task_arithmetic(models, base, 0.4).select("name", "pos", r6("x"))


@query(_TASK + """, k AS (SELECT *, CASE WHEN rank() OVER (PARTITION BY model, name ORDER BY abs(x) DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY model, name) * 0.5)) THEN x ELSE 0 END AS y FROM t),
  e AS (SELECT name, pos, sum(greatest(y, 0)) AS up, sum(greatest(-y, 0)) AS down, sum(greatest(y, 0)) / greatest(count(*) FILTER (y > 0), 1) AS p, sum(least(y, 0)) / greatest(count(*) FILTER (y < 0), 1) AS q FROM k GROUP BY name, pos)
  SELECT name, pos, round(b.x + CASE WHEN up >= down THEN p ELSE q END, 6) + 0.0 AS x FROM e JOIN bx b USING (name, pos)""")
def ties_merge(spark, sf):
    base, models = _two(spark, sf)
    return merge.ties(models, base).select("name", "pos", r6("x"))


@query()
def dare_linear(spark, sf):
    base, models = _two(spark, sf)
    return merge.dare_linear(models, base).select("name", "pos", r6("x"))


# --- codecs

_P = _W + ", p AS (SELECT b.name, b.v AS va, f.v AS vb, list_transform(list_zip(f.v, b.v), lambda p: p[1] - p[2]) AS d FROM base b JOIN ft f ON b.name = f.name)"


@query(_P + ", s AS (SELECT name, d, list_min(d) AS low, (list_max(d) - list_min(d)) / 255.0 AS scale FROM p) SELECT name, round(low, 6) + 0.0 AS low, round(scale, 9) AS scale, round(CASE WHEN scale > 0 THEN list_sum(list_transform(d, lambda x: least(255, floor((x - low) / scale + 0.5)))) ELSE 0 END / 64, 0) AS mean_code FROM s")
def quantized_delta(spark, sf):
    out = codec.quantize(_pairs(spark, sf))
    return out.select("name", r6("low"), F.round("scale", 9).alias("scale"), F.round(S.total(F.col("codes").cast("array<double>")) / 64, 0).alias("mean_code"))


@query(_P + """, q AS (SELECT name, va, d, list_filter(range(len(d)), lambda i: abs(d[i + 1]) > 1e-6) AS pos FROM p)
  SELECT name, len(pos)::BIGINT AS items, array_to_string(pos, ',') AS positions, array_to_string(list_transform(pos, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - pos[i - 1] END), ',') AS gaps,
  round(list_sum(list_transform(va, lambda x, i: (x + CASE WHEN abs(d[i]) > 1e-6 THEN d[i] ELSE 0 END) * i)), 5) + 0.0 AS restored FROM q""")
def sparse_delta(spark, sf):
    out = codec.from_gaps(codec.gaps(codec.from_sparse(codec.sparse(_pairs(spark, sf)))))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    weighed = S.total(F.transform("restored", lambda x, i: x * (i + 1)))
    return out.select("name", F.size("items").cast("long").alias("items"), text("positions").alias("positions"), text("gaps").alias("gaps"), (F.round(weighed, 5) + 0.0).alias("restored"))


@query(_P + "SELECT name, round(list_sum(list_transform(vb, lambda x, i: x::FLOAT::DOUBLE * i)), 5) + 0.0 AS restored, len(list_filter(list_zip(va, vb), lambda p: p[1]::FLOAT <> p[2]::FLOAT))::BIGINT AS changed FROM p")
def xor_delta(spark, sf):
    out = codec.xor_decode(codec.xor_encode(_pairs(spark, sf)))
    weighed = S.total(F.transform("restored", lambda x, i: x.cast("double") * (i + 1)))
    changed = F.size(F.filter(F.zip_with("restored", F.col("va").cast("array<float>"), lambda x, y: x != y), lambda c: c)).cast("long")
    return out.select("name", (F.round(weighed, 5) + 0.0).alias("restored"), changed.alias("changed"))


@query()
def compressed_delta(spark, sf):
    return codec.compressed(_pairs(spark, sf)).select("name", F.length("data").alias("bytes"))


@query(_P + """, c AS (SELECT name, unnest(range(64)) AS pos, unnest(d) AS d FROM p), r AS (SELECT name, pos // 8 AS r, avg(abs(d)) AS rs FROM c GROUP BY ALL),
  k AS (SELECT c.name, pos % 8 AS c, avg(CASE WHEN rs > 0 THEN abs(d) / rs ELSE 0 END) AS cs FROM c JOIN r ON r.name = c.name AND r.r = pos // 8 GROUP BY ALL)
  SELECT c.name, c.pos, round(CASE WHEN d >= 0 THEN 1 ELSE -1 END * rs * cs, 6) + 0.0 AS restored FROM c JOIN r ON r.name = c.name AND r.r = pos // 8 JOIN k ON k.name = c.name AND k.c = pos % 8""")
def per_axis_delta(spark, sf):
    return codec.per_axis(_pairs(spark, sf), 8).select("name", "pos", r6("restored"))


@query(_P + """, c AS (SELECT name, unnest(d) AS d FROM p), s AS (SELECT name, avg(d) AS mean, stddev_pop(d) AS std, min(d) AS low, max(d) AS high, avg((abs(d) < 1e-6)::INT) AS sparsity, count(*) AS n FROM c GROUP BY name)
  SELECT name, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(sparsity, 6) AS sparsity, n, CASE WHEN sparsity > 0.7 THEN 'sparse' WHEN high - low < 2 AND std < 0.1 THEN 'int8' WHEN high - low < 100 THEN 'int16' ELSE 'raw' END AS codec FROM s""")
def delta_statistics(spark, sf):
    return codec.statistics(_pairs(spark, sf)).select("name", r6("mean"), r6("std"), r6("sparsity"), "n", "codec")


@query("SELECT l_quantity AS x, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, l_quantity) - 1)::INT AS code FROM lineitem GROUP BY l_quantity ORDER BY n DESC, x LIMIT 16")
def dictionary_values(spark, sf):
    return codec.dictionary(V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x")), 16)


@query(_P + ", e AS (SELECT name, (4 * len(vb))::BIGINT AS bytes, (8 * len(list_filter(d, lambda x: abs(x) > 1e-6)) + 400)::BIGINT AS estimate FROM p) SELECT *, bytes >= 256 AND 1 - estimate / bytes::DOUBLE > -2.0 AS ok FROM e")
def encodable(spark, sf):
    return codec.encodable(_pairs(spark, sf), "sparse", 256, -2.0).select("name", "bytes", "estimate", "ok")


# --- element statistics


@query(_W + "SELECT grp, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg((x = 0)::INT), 6) AS sparsity FROM bx GROUP BY grp")
def tensor_statistics(spark, sf):
    return stats.describe(_cells(spark, sf)[0], "grp").select("grp", "n", r6("mean"), r6("std"), r6("low"), r6("high"), r6("sparsity"))


@query(_W + ", e AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM bx GROUP BY grp) SELECT grp, least(floor((x - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS n FROM bx JOIN e USING (grp) GROUP BY ALL")
def weight_histogram(spark, sf):
    return stats.histogram(_cells(spark, sf)[0], "grp")


# --- history

_R = f"WITH RECURSIVE {V.EDGES_SQL}, starts(src) AS (VALUES (1500::BIGINT), (1501), (747)), up AS (SELECT src, src AS node FROM starts UNION SELECT up.src, parent FROM up JOIN edges ON child = node)"


def _starts(spark):
    return spark.createDataFrame([(1500,), (1501,), (747,)], "src long")


@query(_R + "SELECT src, node FROM up WHERE src <> node")
def commit_ancestors(spark, sf):
    return history.ancestors(V.edges(spark, sf), _starts(spark)).select("src", "node")


@query(f"WITH RECURSIVE {V.EDGES_SQL}, down AS (SELECT 7::BIGINT AS src, 7::BIGINT AS node UNION SELECT src, child FROM down JOIN edges ON parent = node) SELECT src, node FROM down WHERE src <> node")
def commit_descendants(spark, sf):
    return history.descendants(V.edges(spark, sf), spark.createDataFrame([(7,)], "src long")).select("src", "node")


@query(_R + """, both_ AS (SELECT a.src AS a, b.src AS b, a.node FROM up a JOIN up b ON a.node = b.node AND a.src < b.src),
  above AS (SELECT a, b, parent AS node FROM both_ JOIN edges ON child = node) SELECT a, b, max(node) AS ancestor FROM both_ WHERE (a, b, node) NOT IN (SELECT a, b, node FROM above) GROUP BY a, b""")
def common_ancestors(spark, sf):
    s = _starts(spark)
    pairs = s.select(F.col("src").alias("a")).join(s.select(F.col("src").alias("b")), F.col("a") < F.col("b"))
    return history.common_ancestor(V.edges(spark, sf), pairs)


@query(f"WITH RECURSIVE {V.EDGES_SQL}, chain AS (SELECT 1500::BIGINT AS node, 0 AS depth UNION ALL SELECT parent, depth + 1 FROM chain JOIN edges ON child = node AND place = 0 WHERE depth < 5) SELECT * FROM chain")
def commit_log(spark, sf):
    return history.log(V.edges(spark, sf), spark.createDataFrame([(1500,)], "src long"), 6).select("node", "depth")


@query(_R + ", d AS (SELECT src, src AS node, 0 AS depth FROM starts UNION SELECT src, parent, depth + 1 FROM d JOIN edges ON child = node) SELECT node AS a, src AS b, min(depth) AS depth FROM d WHERE node IN (1, 2, 5) AND src = 1500 GROUP BY ALL")
def commit_paths(spark, sf):
    return history.path_length(V.edges(spark, sf), spark.createDataFrame([(1, 1500), (2, 1500), (5, 1500)], "a long, b long"))


_C = f"WITH {V.CHECKPOINTS_SQL}, w AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM cp), b AS (SELECT *, bb IS NULL OR loss < bb AS is_best FROM w)"


@query(_C + "SELECT run, seq, is_best FROM b")
def best_checkpoints(spark, sf):
    return history.best_so_far(V.checkpoints(spark, sf)).select("run", "seq", "is_best")


@query(_C + ", i AS (SELECT *, sum(CASE WHEN bb IS NULL OR loss < bb - 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq) AS g FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY run, g ORDER BY seq) - 1 AS no_improve FROM i) SELECT run, seq, no_improve::INT AS no_improve, no_improve >= 5 AS stop FROM n")
def early_stopping(spark, sf):
    return history.early_stopping(V.checkpoints(spark, sf)).select("run", "seq", F.col("no_improve").cast("int").alias("no_improve"), "stop")


@query(_C + "SELECT run, seq, step % 50 = 0 OR epoch % 5 = 0 OR is_best AS save FROM b")
def checkpoints_to_save(spark, sf):
    return history.should_save(V.checkpoints(spark, sf)).select("run", "seq", "save")


@query(_C + ", r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS n1, row_number() OVER (PARTITION BY run, is_best ORDER BY loss, seq) AS n2, row_number() OVER (PARTITION BY run ORDER BY loss, seq) AS n3 FROM b) SELECT run, seq FROM r WHERE n1 <= 3 OR (is_best AND n2 <= 2) OR epoch % 10 = 0 OR n3 = 1")
def checkpoints_retained(spark, sf):
    return history.retained(V.checkpoints(spark, sf)).select("run", "seq")


@query(_C + "SELECT run, max(seq) AS seq, arg_max(loss, seq) AS loss FROM b GROUP BY run")
def latest_checkpoint(spark, sf):
    return history.latest(V.checkpoints(spark, sf))


# --- identities and text


@query("SELECT o_orderkey, left(sha256(o_orderkey::VARCHAR || ':' || o_custkey::VARCHAR), 16) AS version_id, left(sha256(o_orderkey::VARCHAR), 8) AS short FROM orders")
def version_ids(spark, sf):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return V.table(spark, sf, "orders").select("o_orderkey", F.left(sha(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))), F.lit(16)).alias("version_id"), F.left(sha(F.col("o_orderkey").cast("string")), F.lit(8)).alias("short"))


@query("WITH w AS (SELECT DISTINCT left(sha256(c_custkey::VARCHAR), 12) AS ref, sha256(c_custkey::VARCHAR) AS commit FROM customer WHERE c_custkey % 7 = 3) SELECT ref, commit FROM w UNION ALL SELECT 'branch-' || c_custkey, sha256(c_custkey::VARCHAR) FROM customer WHERE c_custkey % 7 = 4")
def resolved_refs(spark, sf):
    rows = V.table(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("commit"))
    branches = rows.filter("c_custkey % 7 = 4").select(F.concat(F.lit("branch-"), "c_custkey").alias("name"), "commit", F.lit("branch").alias("kind"))
    refs = rows.select(F.col("commit").alias("name"), "commit", F.lit("commit").alias("kind")).unionByName(branches)
    wanted = rows.filter("c_custkey % 7 = 3").select(F.left("commit", F.lit(12)).alias("ref")).unionByName(branches.select(F.col("name").alias("ref")))
    return store.resolve(refs, wanted)


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, n_chars * 64 AS n FROM documents)")
def readable_sizes(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.human_bytes(F.col("n_chars") * 64).alias("size"))


@query("WITH u AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 's3://b' || o_custkey || '/x' WHEN 1 THEN 'minio://h:9/b' || o_custkey || '/x' WHEN 2 THEN 'file:///m' || o_custkey ELSE 'ftp://q' END AS url FROM orders) SELECT o_orderkey, CASE WHEN url LIKE 's3:%' OR url LIKE 'minio:%' THEN 's3' WHEN url LIKE 'file:%' THEN 'file' END AS kind, CASE WHEN url LIKE 's3:%' THEN split_part(url, '/', 3) WHEN url LIKE 'minio:%' THEN split_part(url, '/', 4) END AS bucket FROM u")
def remote_urls(spark, sf):
    key = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    url = F.when(kind == 0, F.concat(F.lit("s3://b"), key, F.lit("/x"))).when(kind == 1, F.concat(F.lit("minio://h:9/b"), key, F.lit("/x"))).when(kind == 2, F.concat(F.lit("file:///m"), key)).otherwise("ftp://q")
    return V.table(spark, sf, "orders").withColumn("url", url).select("o_orderkey", X.remote_kind(F.col("url")).alias("kind"), X.remote_bucket(F.col("url")).alias("bucket"))


@query("SELECT event_id, 'epoch ' || (event_id % 9) || ' step ' || event_id || ': ' || event_type AS message FROM events")
def commit_messages(spark, sf):
    rows = V.table(spark, sf, "events")
    return rows.select("event_id", X.commit_message("epoch {epoch} step {step}: {note}", epoch=F.col("event_id") % 9, step=F.col("event_id"), note=F.col("event_type")).alias("message"))


@query(_M + "SELECT name, 'missing' AS problem FROM m1 WHERE name NOT IN (SELECT name FROM m2) UNION ALL SELECT name, 'unexpected' FROM m2 WHERE name NOT IN (SELECT name FROM m1)")
def load_key_check(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return store.key_check(ours, theirs)


@query("SELECT (sum(n_chars) FILTER (doc_id % 3 <> 0))::BIGINT AS moved, (sum(n_chars) FILTER (doc_id % 3 = 0))::BIGINT AS saved, round(sum(n_chars) FILTER (doc_id % 3 = 0) * 100.0 / sum(n_chars), 6) AS percent FROM documents")
def transfer_savings(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("n_chars").alias("bytes"), (F.col("doc_id") % 3 == 0).alias("cached"))
    return store.transfer_savings(rows).select("moved", "saved", r6("percent"))


@query("SELECT event_id AS id, ts AS at FROM events WHERE event_id % 5 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def publish_history(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_id") % 5 != 0).alias("ok"))
    return store.newest(rows).select("id", "at")


@query(_P + """, s AS (SELECT name, d, list_sum(d) / len(d) AS m FROM p), t AS (SELECT name, d, m, sqrt(list_sum(list_transform(d, lambda x: (x - m) * (x - m))) / len(d)) AS sd FROM s)
  SELECT name, round(m - 3 * sd, 6) + 0.0 AS low, round(len(list_filter(d, lambda x: x < m - 3 * sd OR x > m + 3 * sd)) / len(d), 6) AS outliers FROM t""")
def adaptive_quantization(spark, sf):
    return codec.adaptive_quantize(_pairs(spark, sf)).select("name", r6("low"), r6("outliers"))


@query(f"WITH RECURSIVE {V.EDGES_SQL}, chain AS (SELECT 1500::BIGINT AS node, 0 AS depth UNION ALL SELECT parent, depth + 1 FROM chain JOIN edges ON child = node AND place = 0), {V.MANIFEST_SQL} SELECT node, depth, hash FROM chain JOIN m0 ON m0.name = node")
def weight_history(spark, sf):
    chain = history.log(V.edges(spark, sf), spark.createDataFrame([(1500,)], "src long"), 1_000_000)
    return chain.join(V.manifest(spark, sf, 0), F.col("node") == F.col("name")).select("node", "depth", "hash")
