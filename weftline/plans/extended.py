"""More registered queries: stores, deltas, indexes, syncing, runs, records and embedded functions, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.functions import text as X
from weftline.operators import codec, compare, dedup, deltas, history, index, merge, remotes, runs, store
from weftline.plans import views as V
from weftline.plans.catalog import _C, _M, _P, _R, _TASK, _W, _cells, _manifests, _models, _pairs, _two, query, r6

# --- stores

_OBJ = "WITH obj AS (SELECT o_orderkey AS hash, o_custkey AS raw_bytes, o_custkey // 2 AS stored_bytes, o_orderstatus AS kind FROM orders), want AS (SELECT DISTINCT l_orderkey + (l_linenumber % 2) * 100000000 AS hash FROM lineitem WHERE l_returnflag = 'R') "


def _objects(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("raw_bytes"), F.floor(F.col("o_custkey") / 2).alias("stored_bytes"), F.col("o_orderstatus").alias("kind"))


def _wanted(spark, sf):
    return V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_orderkey") + (F.col("l_linenumber") % 2) * 100_000_000).alias("hash")).distinct()


@query(_OBJ + "SELECT hash, hash IN (SELECT hash FROM obj) AS found FROM want")
def objects_present(spark, sf):
    return store.present(_wanted(spark, sf), _objects(spark, sf))


@query(_OBJ + "SELECT hash, raw_bytes, kind FROM obj WHERE hash IN (SELECT hash FROM want)")
def objects_loaded(spark, sf):
    return _objects(spark, sf).join(_wanted(spark, sf), "hash", "left_semi").select("hash", "raw_bytes", "kind")


@query(_OBJ + "SELECT hash, raw_bytes FROM obj WHERE hash NOT IN (SELECT hash FROM want)")
def objects_after_delete(spark, sf):
    return index.removed(_objects(spark, sf).withColumnRenamed("hash", "id"), _wanted(spark, sf).withColumnRenamed("hash", "id")).select(F.col("id").alias("hash"), "raw_bytes")


@query("SELECT o_orderkey AS name, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN (o_custkey % 9) + 1 ELSE ((o_custkey % 9) + 1) * 4 END::BIGINT AS size, 4 * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN (o_custkey % 9) + 1 ELSE ((o_custkey % 9) + 1) * 4 END::BIGINT AS nbytes FROM orders")
def tensor_metadata(spark, sf):
    first = (F.col("o_custkey") % 9 + 1).cast("long")
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<bigint>")).when(F.col("o_orderkey") % 3 == 1, F.array(first)).otherwise(F.array(first, F.lit(4).cast("long")))
    return store.metadata(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), shape.alias("shape")))


@query("SELECT o_orderkey AS name FROM orders WHERE o_orderpriority LIKE '1-%' AND o_custkey % 2 = 0")
def filtered_names(spark, sf):
    """Names by a predicate on the name and on metadata, before any values are read; nothing left stays nothing."""
    rows = V.table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1-") & (F.col("o_custkey") % 2 == 0))
    return rows.select(F.col("o_orderkey").alias("name"))


# --- deltas


@query(_P + "SELECT name, round(list_sum(list_transform(d, lambda x, i: x::FLOAT::DOUBLE * i)), 4) + 0.0 AS weighed, round(list_sum(vb), 4) + 0.0 AS restored FROM p")
def raw_delta(spark, sf):
    out = codec.from_raw(codec.raw(_pairs(spark, sf)))
    weighed = S.total(F.transform("d", lambda x, i: x.cast("double") * (i + 1)))
    return out.select("name", (F.round(weighed, 4) + 0.0).alias("weighed"), (F.round(S.total(F.col("restored")), 4) + 0.0).alias("restored"))


@query(_P + """, s AS (SELECT name, va, vb, d, list_min(d) AS low, (list_max(d) - list_min(d)) / 65535.0::DOUBLE AS scale FROM p),
  q AS (SELECT *, list_transform(d, lambda x: CASE WHEN scale > 0 THEN least(65535, floor((x - low) / scale + 0.5)) ELSE 0 END) AS codes FROM s)
  SELECT name, round(list_sum(codes), -1) + 0.0 AS codes, round(list_sum(list_transform(list_zip(va, codes), lambda p: p[1] + p[2] * scale + low)), 3) + 0.0 AS restored FROM q""")
def quantized16_delta(spark, sf):
    out = codec.dequantize(codec.quantize(_pairs(spark, sf), 16))
    return out.select("name", (F.round(S.total(F.col("codes").cast("array<double>")), -1) + 0.0).alias("codes"), (F.round(S.total(F.col("restored")), 3) + 0.0).alias("restored"))


_SIZES = _P + """, n AS (SELECT name, len(d) AS n, len(list_filter(d, lambda x: abs(x) > 1e-6)) AS k FROM p),
  e AS (SELECT name, kind, (4 * n)::BIGINT AS bytes, (CASE kind WHEN 'sparse' THEN 8 * k WHEN 'int8' THEN n WHEN 'int16' THEN 2 * n ELSE 4 * n END + 400)::BIGINT AS estimate FROM n, (VALUES ('sparse'), ('int8'), ('int16'), ('raw')) v(kind))
"""


@query(_SIZES + "SELECT name, kind, bytes, estimate, bytes >= 200 AND 1 - estimate / bytes::DOUBLE > -1.0 AS ok FROM e")
def codec_sizes(spark, sf):
    out = None
    for kind in ("sparse", "int8", "int16", "raw"):
        rows = codec.encodable(_pairs(spark, sf), kind, 200, -1.0).select("name", F.lit(kind).alias("kind"), "bytes", "estimate", "ok")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_P + "SELECT name, (len(list_filter(list_zip(va, vb), lambda p: p[1]::FLOAT <> p[2]::FLOAT)) > 0) AS changed, len(vb)::BIGINT AS equal_bits, len(vb)::BIGINT AS equal_bits16 FROM p")
def xor_round_trips(spark, sf):
    """Elements of both XOR codecs that come back bit by bit, and whether there was anything to encode."""
    pairs = _pairs(spark, sf).withColumns({c: F.col(c).cast("array<float>").cast("array<double>") for c in ("va", "vb")})
    same = lambda kind: F.size(F.filter(F.zip_with(f"restored.{kind}", "vb", lambda x, y: x == y), lambda ok: ok)).cast("long")
    out = codec.round_trips(pairs).withColumns({"equal_bits": same("xor_float32"), "equal_bits16": same("xor_bfloat16")})
    return out.select("name", (F.col("va") != F.col("vb")).alias("changed"), "equal_bits", "equal_bits16")


@query("SELECT k AS kind, k LIKE 'xor%' AS lossless FROM (VALUES ('raw'), ('int8'), ('int16'), ('sparse'), ('compressed'), ('xor_float32'), ('xor_bfloat16'), ('exponent_mantissa'), ('per_axis')) v(k)")
def lossless_kinds(spark, sf):
    return spark.createDataFrame([(k, k in codec.LOSSLESS) for k in codec.KINDS], "kind string, lossless boolean")


@query(_P + "SELECT name, round(list_sum(list_transform(vb, lambda x, i: x * i)), 4) + 0.0 AS weighed, CASE WHEN name % 5 = 0 THEN false ELSE true END AS encoded FROM p")
def reconstructed_weights(spark, sf):
    """A commit's tensors from deltas against its parent's (raw differences) and from whole objects."""
    base, tuned = _models(spark, sf)
    hashed = lambda m: m.select("name", deltas.content_hash(F.col("values")).alias("hash"), "values")
    old, new = hashed(base), hashed(tuned)
    made = deltas.against_parent(new, old, "raw", least_bytes=0, least_ratio=-1e9)
    manifest = new.select("name", "hash").join(made.select("name", "delta_hash"), "name", "left")
    whole = old.select("hash", "values").unionByName(new.join(made, "name", "left_anti").select("hash", "values")).dropDuplicates(["hash"])
    out = deltas.reconstructed(manifest, whole, made.dropDuplicates(["delta_hash"])).join(deltas.delta_of(manifest, manifest).select("name", "encoded"), "name")
    return out.select("name", (F.round(S.total(F.transform("values", lambda x, i: x * (i + 1))), 4) + 0.0).alias("weighed"), "encoded")


@query(_P + "SELECT count(*) AS deltas, (count(*) * 256)::BIGINT AS data_bytes, (count(*) * 256)::BIGINT AS original_bytes FROM p WHERE name % 5 <> 0")
def delta_storage_info(spark, sf):
    base, tuned = _models(spark, sf)
    hashed = lambda m: m.select("name", deltas.content_hash(F.col("values")).alias("hash"), "values")
    return deltas.storage_info(deltas.against_parent(hashed(tuned), hashed(base), "raw", least_bytes=0, least_ratio=-1e9))


@query("WITH top AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY count(*) DESC, l_quantity) - 1 AS code FROM lineitem GROUP BY 1 QUALIFY code < 16) SELECT l.l_quantity AS x, code::INT AS code, CASE WHEN code IS NULL THEN l.l_quantity END AS literal, count(*) AS n FROM lineitem l LEFT JOIN top ON l.l_quantity = top.x GROUP BY ALL")
def dictionary_codes(spark, sf):
    cells = V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"))
    return codec.with_dictionary(cells, 16).groupBy("x", "code", "literal").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1")
def dictionary_decoded(spark, sf):
    cells = V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"))
    return codec.from_dictionary(codec.with_dictionary(cells, 16), codec.dictionary(cells, 16)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query(_P + """, c AS (SELECT name, unnest(d) AS d FROM p), s AS (SELECT name, min(d) AS lo, max(d) AS hi, count(*) AS n, avg((d = 0)::INT) AS zero_ratio, max(d) - min(d) AS width FROM c GROUP BY name),
  b AS (SELECT name, CASE WHEN hi > lo THEN least(255, floor((d - lo) / (hi - lo) * 256)) ELSE 0 END AS slot, count(*) AS k, any_value(n) AS n FROM c JOIN s USING (name) GROUP BY ALL)
  SELECT name, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) + 0.0 AS entropy FROM b WHERE name % 5 <> 0 GROUP BY name""")
def delta_entropy(spark, sf):
    return codec.statistics(_pairs(spark, sf)).filter("name % 5 <> 0").select("name", r6("entropy"))


@query(_P + ", c AS (SELECT name, unnest(d) AS d FROM p) SELECT name, round(stddev_pop(d), 6) + 0.0 AS std_delta FROM c GROUP BY name")
def delta_spread(spark, sf):
    return compare.compare_models(*_models(spark, sf)).filter("status = 'both'").select("name", r6("std_delta"))


# --- comparing with other frameworks' rules

_J = f"WITH {V.MODELS_SQL}, j AS (SELECT coalesce(b.name, f.name) AS name, b.v AS va, f.v AS vb FROM base b FULL OUTER JOIN ft f ON b.name = f.name), g AS (SELECT *, list_transform(list_zip(va, vb), lambda p: abs(p[1] - p[2])) AS ad FROM j) "


@query(_J + "SELECT name, CASE WHEN va IS NULL THEN 'model_only' WHEN vb IS NULL THEN 'saved_only' WHEN len(list_filter(list_zip(va, vb), lambda p: abs(p[1] - p[2]) > 1e-6 + 1e-5 * abs(p[2]))) = 0 THEN 'identical' ELSE 'modified' END AS state, CASE WHEN vb IS NOT NULL THEN round(list_max(ad), 6) + 0.0 END AS largest FROM g")
def parameter_diff(spark, sf):
    return compare.diff_parameters(*_models(spark, sf)).select("name", "state", r6("largest"))


@query(_J + "SELECT name, CASE WHEN vb IS NULL THEN 'saved_only' WHEN list_max(ad) <= 0.0035 THEN 'identical' ELSE 'modified' END AS state FROM g")
def tolerance_diff(spark, sf):
    return compare.within(*_models(spark, sf), 0.0035).select("name", "state")


_B = _J + ", k AS (SELECT name, va, vb, list_dot_product(va, vb) / sqrt(list_dot_product(va, va)) / sqrt(list_dot_product(vb, vb)) AS cos, least(sqrt(list_dot_product(va, va)), sqrt(list_dot_product(vb, vb))) / greatest(sqrt(list_dot_product(va, va)), sqrt(list_dot_product(vb, vb))) AS mag FROM j WHERE va IS NOT NULL AND vb IS NOT NULL), bk AS (SELECT name, CASE WHEN va = vb THEN 'identical' WHEN cos >= 0.99 AND mag >= 0.9 THEN 'similar' ELSE 'different' END AS bucket, round(0.7 * (cos + 1) / 2 + 0.3 * mag, 6) AS score FROM k) "


@query(_B + "SELECT * FROM bk")
def model_buckets(spark, sf):
    return compare.bucketed(*_models(spark, sf)).select("name", "bucket", r6("score"))


@query(_B + "SELECT count(*) FILTER (bucket = 'identical') AS identical, count(*) FILTER (bucket = 'similar') AS similar, count(*) FILTER (bucket = 'different') AS different, round(count(*) FILTER (bucket <> 'different') * 100.0 / count(*), 6) AS percent FROM bk")
def reusable_layers(spark, sf):
    return compare.reusable_share(compare.bucketed(*_models(spark, sf))).select("identical", "similar", "different", r6("percent"))


@query(_J + "SELECT name, CASE WHEN vb IS NULL THEN 'model' ELSE 'saved' END AS source, round(list_sum(coalesce(vb, va)), 6) + 0.0 AS total FROM g")
def restored_model(spark, sf):
    base, tuned = _models(spark, sf)
    return compare.restored(base, tuned).select("name", "source", (F.round(S.total(F.col("values")), 6) + 0.0).alias("total"))


@query(_J + "SELECT name FROM g ORDER BY name")
def sorted_layers(spark, sf):
    return compare.compare_models(*_models(spark, sf)).orderBy("name").select("name")


# --- similarity joins and assignments

_LIB = f"""WITH RECURSIVE {V.MODELS_SQL}, lib AS (SELECT name, v FROM base UNION ALL SELECT name + 10000000, v FROM ft),
firsts AS (SELECT v, min(name) AS name FROM lib GROUP BY v), nrm AS (SELECT name, v, sqrt(list_dot_product(v, v)) AS nv FROM firsts),
cs AS (SELECT a.name AS a, b.name AS b, list_dot_product(a.v, b.v) / (a.nv * b.nv) AS cos, least(a.nv, b.nv) / greatest(a.nv, b.nv) AS mag FROM nrm a JOIN nrm b ON a.name < b.name),
pr AS (SELECT a, b, 0.7 * (cos + 1) / 2 + 0.3 * mag AS score FROM cs WHERE cos >= 0.98 AND mag >= 0.9 AND 0.7 * (cos + 1) / 2 + 0.3 * mag > 0.98),
line AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM firsts), near AS (SELECT b, list(a) AS earlier FROM pr GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS uniques UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(w.uniques, coalesce(n.earlier, [])) THEN w.uniques ELSE list_append(w.uniques, l.name) END FROM walk w JOIN line l ON l.i = w.i + 1 LEFT JOIN near n ON n.b = l.name),
uniq AS (SELECT unnest(uniques) AS name FROM walk WHERE i = (SELECT max(i) FROM walk)),
best AS (SELECT b AS name, max(score) AS score FROM pr JOIN uniq ON a = uniq.name GROUP BY b),
refs AS (SELECT pr.b AS name, min(pr.a) AS ref FROM pr JOIN best ON best.name = pr.b AND best.score = pr.score JOIN uniq ON pr.a = uniq.name GROUP BY pr.b),
decided AS (SELECT f.name AS first, f.v, CASE WHEN f.name IN (SELECT name FROM uniq) THEN 'unique' ELSE 'similar' END AS kind, r.ref, b.score FROM firsts f LEFT JOIN refs r ON r.name = f.name LEFT JOIN best b ON b.name = f.name),
asg AS (SELECT l.name, CASE WHEN kind = 'unique' AND l.name <> first THEN 'duplicate' ELSE kind END AS kind, CASE WHEN kind = 'unique' THEN first ELSE ref END AS ref, CASE WHEN kind = 'similar' THEN score END AS score FROM lib l JOIN decided d ON l.v = d.v)
"""


def _library(spark, sf):
    a, b = _models(spark, sf)
    return a.select("name", "values").unionByName(b.select((F.col("name") + 10_000_000).alias("name"), "values"))


@query(_LIB + "SELECT name, kind, ref, round(score, 6) + 0.0 AS score FROM asg")
def near_dedup(spark, sf):
    return dedup.assign_all(_library(spark, sf)).select("name", "kind", "ref", r6("score"))


@query(_LIB + "SELECT a, b, round(score, 6) + 0.0 AS score FROM pr")
def similar_pairs(spark, sf):
    library = _library(spark, sf)
    firsts = library.groupBy("values").agg(F.min("name").alias("name"))
    return dedup.similar_pairs(firsts).select("a", "b", r6("score"))


@query(_P + ", k AS (SELECT name, list_dot_product(va, vb) / sqrt(list_dot_product(va, va)) / sqrt(list_dot_product(vb, vb)) AS cos, least(sqrt(list_dot_product(va, va)), sqrt(list_dot_product(vb, vb))) / greatest(sqrt(list_dot_product(va, va)), sqrt(list_dot_product(vb, vb))) AS mag FROM p) SELECT name, name AS ref, round(0.7 * (cos + 1) / 2 + 0.3 * mag, 6) + 0.0 AS score FROM k WHERE 0.7 * (cos + 1) / 2 + 0.3 * mag > 0.98 AND mag >= 0.9")
def best_references(spark, sf):
    base, tuned = _models(spark, sf)
    return dedup.best_reference(tuned.select("name", "values"), base.select("name", "values")).select("name", "ref", r6("score"))


def _sizes(library):
    return library.select("name", (F.size("values") * 4 + F.col("name") % 3).cast("long").alias("bytes"))


_SZ = _LIB + ", sz AS (SELECT name, (len(v) * 4 + name % 3)::BIGINT AS bytes FROM lib), dl AS (SELECT name, 100::BIGINT AS delta FROM lib WHERE name % 2 = 0 AND name > 10000000), full_ AS (SELECT a.*, sz.bytes, CASE WHEN kind = 'similar' THEN dl.delta END AS delta FROM asg a JOIN sz USING (name) LEFT JOIN dl USING (name)), held AS (SELECT *, CASE kind WHEN 'unique' THEN bytes WHEN 'similar' THEN coalesce(delta, bytes // 2) ELSE 0 END AS stored FROM full_)"


def _assigned(spark, sf):
    library = _library(spark, sf)
    assigned = dedup.cut(dedup.assign_all(library))
    some = assigned.filter("kind = 'similar' and name % 2 = 0 and name > 10000000").select("name", F.lit(100).cast("long").alias("bytes"))
    return assigned, _sizes(library), some


@query(_SZ + "SELECT count(*) AS total, count(*) FILTER (kind = 'unique') AS unique_tensors, count(*) FILTER (kind = 'duplicate') AS duplicates, count(*) FILTER (kind = 'similar') AS similars, count(delta) AS deltas, sum(bytes)::BIGINT AS original_bytes, sum(stored)::BIGINT AS stored_bytes, coalesce(sum(delta), 0)::BIGINT AS delta_bytes, round(1 - sum(stored) / sum(bytes), 6) AS saved_share, round(coalesce(1 - sum(delta) / sum(bytes) FILTER (delta IS NOT NULL), 0), 6) AS delta_share FROM held")
def compression_stats(spark, sf):
    out = dedup.statistics(*_assigned(spark, sf))
    return out.select("total", "unique_tensors", "duplicates", "similars", "deltas", "original_bytes", F.col("stored_bytes").cast("long").alias("stored_bytes"), "delta_bytes", r6("saved_share"), r6("delta_share"))


@query(_SZ + "SELECT ref, count(*) AS members, sum(bytes - stored)::BIGINT AS saved FROM held GROUP BY ref HAVING count(*) > 1 ORDER BY sum(CASE WHEN kind = 'unique' THEN 0 ELSE bytes - stored END) DESC, ref LIMIT 10")
def group_savings(spark, sf):
    return dedup.group_savings(*_assigned(spark, sf), 10)


@query(_SZ + ", t AS (SELECT count(*) FILTER (kind = 'unique') AS u, count(*) FILTER (kind = 'duplicate') AS d, count(*) FILTER (kind = 'similar') AS s FROM held) SELECT unnest(['unique', 'duplicate', 'similar']) AS label, unnest([u, d, s])::BIGINT AS n FROM t")
def dedup_chart(spark, sf):
    out = dedup.statistics(*_assigned(spark, sf))
    return out.selectExpr("stack(3, 'unique', unique_tensors, 'duplicate', duplicates, 'similar', similars) as (label, n)")


@query(_LIB + "SELECT 10000000 + w.name AS wanted, a.name, a.kind FROM (SELECT name FROM base WHERE name % 5 = 3) w JOIN asg q ON q.name = 10000000 + w.name JOIN asg a ON a.ref = q.ref")
def weight_groups(spark, sf):
    assigned = dedup.cut(dedup.assign_all(_library(spark, sf)))
    return dedup.group_of(assigned, assigned.filter("name > 10000000 and name % 5 = 3").select("name"))


@query(_M + ", all_ AS (SELECT 'm0' AS commit, name, hash FROM m0 UNION ALL SELECT 'm1', name, hash FROM m1 UNION ALL SELECT 'm2', name, hash FROM m2), s AS (SELECT hash, count(*) AS n FROM all_ GROUP BY hash) SELECT (SELECT count(DISTINCT commit) FROM all_) AS commits, (SELECT count(*) FROM all_) AS refs, count(*) AS unique_objects, (sum(n) - count(*))::BIGINT AS duplicates, sum(hash % 1000)::BIGINT AS bytes FROM s")
def repo_stats(spark, sf):
    every = None
    for i, m in enumerate(_manifests(spark, sf)):
        rows = m.withColumn("commit", F.lit(f"m{i}"))
        every = rows if every is None else every.unionByName(rows)
    return store.repository_stats(every, every.select("hash", (F.col("hash") % 1000).alias("bytes")).distinct())


# --- fingerprints

_FP = "WITH fp AS (SELECT o_orderkey AS id, (o_orderkey % 2 + 1)::INT AS dim, o_custkey * 2654435761 AS w FROM orders WHERE o_orderkey % 2 < 2) "


def _fp(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("dim"), F.array(F.col("o_custkey").cast("long") * F.lit(2654435761)).alias("fp"))


@query(_FP + "SELECT q.id AS query, x.id, bit_count(xor(q.w, x.w))::INT AS distance FROM fp q JOIN fp x ON q.dim = x.dim AND q.id <> x.id WHERE q.id % 50 = 0 AND bit_count(xor(q.w, x.w)) <= 6 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.w, x.w)), x.id) <= 5")
def hamming_scan(spark, sf):
    rows = _fp(spark, sf)
    return index.scan(rows, rows.filter("id % 50 = 0"), 6, 5)


@query(_FP + "SELECT dim, count(*) AS vectors, count(DISTINCT w) AS fingerprints, round(count(*) / count(DISTINCT w), 6) AS mean FROM fp GROUP BY dim")
def fingerprint_index_stats(spark, sf):
    return index.fingerprint_stats(_fp(spark, sf)).select("dim", "vectors", "fingerprints", r6("mean"))


@query(_FP + "SELECT id, dim, w FROM (SELECT id, dim, w FROM fp WHERE id % 3 <> 0 AND id % 7 <> 0 UNION ALL SELECT id, dim, w + 1 FROM fp WHERE id % 7 = 0)")
def fingerprints_replaced(spark, sf):
    """An index after inserting some ids again and removing others."""
    rows = _fp(spark, sf)
    again = rows.filter("id % 7 = 0").withColumn("fp", F.transform("fp", lambda x: x + 1))
    gone = rows.filter("id % 3 = 0 and id % 7 <> 0").select("id")
    return index.removed(index.inserted(rows, again), gone).select("id", "dim", F.get("fp", F.lit(0)).alias("w"))


@query(_FP + "SELECT DISTINCT l_orderkey AS id, l_orderkey IN (SELECT id FROM fp WHERE id % 4 = 0) AS found FROM lineitem")
def fingerprints_contained(spark, sf):
    return index.contains(_fp(spark, sf).filter("id % 4 = 0"), V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query(_FP + "SELECT a.id AS a, b.id AS b, bit_count(xor(a.w, b.w)) <= 12 AS alike FROM fp a JOIN fp b ON b.id = a.id + 1")
def fingerprints_alike(spark, sf):
    rows = _fp(spark, sf)
    pair = rows.select(F.col("id").alias("a"), F.col("fp").alias("fa")).join(rows.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("fp").alias("fb")), "a")
    return pair.select("a", "b", index.alike(F.col("fa"), F.col("fb"), 64, 0.2).alias("alike"))


# --- merging


@query(_W + "SELECT name, pos, round(CASE WHEN f.x IS NULL THEN b.x ELSE (b.x + f.x) / 2 END, 6) + 0.0 AS x FROM bx b LEFT JOIN fx f USING (name, pos)")
def merge_average(spark, sf):
    return merge.average(*_cells(spark, sf)).select("name", "pos", r6("x"))


_TW = _M + ", r AS (SELECT coalesce(o.name, t.name, b.name) AS name, o.hash AS o, t.hash AS t, b.hash AS b FROM m1 o FULL OUTER JOIN m2 t ON o.name = t.name FULL OUTER JOIN m0 b ON b.name = coalesce(o.name, t.name)), c AS (SELECT *, o IS DISTINCT FROM t AND o IS DISTINCT FROM b AND t IS DISTINCT FROM b AS conflict FROM r) "


@query(_TW + "SELECT name, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o ELSE coalesce(t, o) END AS hash FROM c WHERE CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o ELSE coalesce(t, o) END IS NOT NULL")
def merge_theirs(spark, sf):
    base, ours, theirs = _manifests(spark, sf)
    return compare.three_way(base, theirs, ours).select("name", "hash")


@query(_TW + "SELECT name FROM c WHERE conflict AND coalesce(o, t) IS NOT NULL")
def merge_conflicts(spark, sf):
    return compare.three_way(*_manifests(spark, sf)).filter("conflict").select("name")


_KEPT = _TASK + ", k AS (SELECT *, CASE WHEN rank() OVER (PARTITION BY model, name ORDER BY abs(x) DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY model, name) * 0.5)) THEN x ELSE 0 END AS y FROM t), e AS (SELECT name, pos, count(*) FILTER (y > 0) AS up, count(*) FILTER (y < 0) AS down, coalesce(sum(y) FILTER (y > 0), 0) AS su, coalesce(sum(y) FILTER (y < 0), 0) AS sd FROM k GROUP BY name, pos) "


@query(_KEPT + "SELECT name, pos, round(b.x + CASE WHEN up >= down THEN su / greatest(up, 1) ELSE sd / greatest(down, 1) END, 6) + 0.0 AS x FROM e JOIN bx b USING (name, pos)")
def ties_by_frequency(spark, sf):
    base, models = _two(spark, sf)
    return merge.ties(models, base, elect="frequency").select("name", "pos", r6("x"))


@query(_KEPT + "SELECT ((SELECT count(*) FROM t WHERE x <> 0) - sum(up + down))::BIGINT AS trimmed, count(*) FILTER (up > 0 AND down > 0) AS conflicts FROM e")
def ties_counts(spark, sf):
    base, models = _two(spark, sf)
    return merge.ties_counts(models, base)


@query()
def dare_ties(spark, sf):
    base, models = _two(spark, sf)
    return merge.dare_ties(models, base, 0.5).select("name", "pos", r6("x"))


@query(_TASK + "SELECT name, pos, round(any_value(b.x) + 0.7 * avg(t.x), 6) + 0.0 AS x FROM t JOIN bx b USING (name, pos) GROUP BY name, pos")
def soup_dispatch(spark, sf):
    """Task arithmetic over two models through the dispatcher, scaled to the mean where both have the element."""
    base, models = _two(spark, sf)
    out = merge.soup(models, merge.SoupConfig(method="task", scale=0.7), base)
    n = merge.stacked(models).groupBy("name", "pos").agg(F.count("x").alias("n"))
    own = base.select("name", "pos", F.col("x").alias("b"))
    both = out.join(n, ["name", "pos"]).join(own, ["name", "pos"])
    return both.select("name", "pos", (F.round(F.col("b") + (F.col("x") - F.col("b")) / F.col("n"), 6) + 0.0).alias("x"))


# --- syncing

_SY = _M + ", l AS (SELECT DISTINCT hash FROM m1), r AS (SELECT DISTINCT hash FROM m2), pl AS (SELECT hash, 'push' AS action FROM l WHERE hash NOT IN (SELECT hash FROM r) UNION ALL SELECT hash, 'pull' FROM r WHERE hash NOT IN (SELECT hash FROM l)) "


@query(_SY + "SELECT hash FROM pl WHERE action = 'pull'")
def pull_set(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return remotes.plan(ours, theirs, "pull").select("hash")


@query(_SY + "SELECT * FROM pl")
def sync_plan(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return remotes.plan(ours, theirs)


@query(_SY + "SELECT hash FROM l WHERE hash % 3 = 0")
def push_subset_forced(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    subset = ours.select("hash").distinct().filter("hash % 3 = 0")
    return remotes.plan(ours, theirs, "push", True, subset).select("hash")


@query(_SY + "SELECT action, count(*) FILTER (hash % 17 <> 0) AS moved, coalesce(sum(hash % 100) FILTER (hash % 17 <> 0), 0)::BIGINT AS bytes, count(*) FILTER (hash % 17 = 0) AS errors, count(*) FILTER (hash % 17 = 0) = 0 AS success FROM pl GROUP BY action")
def sync_result(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    planned = remotes.plan(ours, theirs)
    sizes = planned.select("hash", (F.col("hash") % 100).alias("bytes"))
    return remotes.result(planned, sizes, planned.filter("hash % 17 = 0"))


@query(_SY + ", u AS (SELECT hash FROM l UNION SELECT hash FROM r) SELECT 0::BIGINT AS ahead, 0::BIGINT AS behind, count(*) AS synced, count(*) = (SELECT count(*) FROM u) AS is_synced FROM u")
def status_after_sync(spark, sf):
    _, ours, theirs = _manifests(spark, sf)
    return store.sync_status(*remotes.after(ours, theirs, remotes.plan(ours, theirs)))


@query(_M + "SELECT m1.name, m1.hash, m0.hash IS NOT NULL AND m0.hash = m1.hash AS cached, (m1.hash % 100)::BIGINT AS bytes FROM m1 LEFT JOIN m0 USING (name)")
def transfer_plan(spark, sf):
    """What a download has to move: tensors whose hash the base lacks."""
    base, ours, _ = _manifests(spark, sf)
    pair = ours.join(base.select("name", F.col("hash").alias("h")), "name", "left")
    return pair.select("name", "hash", F.coalesce(F.col("h") == F.col("hash"), F.lit(False)).alias("cached"), (F.col("hash") % 100).alias("bytes"))


# --- runs, checkpoints, publishing

_LK = "WITH lk AS (SELECT o_custkey AS run, o_orderkey AS commit, o_orderdate AS t FROM orders), cr AS (SELECT run, arg_max(commit, {'a': t, 'c': commit}) AS commit FROM lk WHERE run % 3 = 0 GROUP BY run) "


def _links(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))


def _asked(spark, sf):
    return V.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("run"))


@query(_LK + "SELECT * FROM cr")
def run_commits(spark, sf):
    return runs.commit_of_run(_links(spark, sf), _asked(spark, sf))


@query("SELECT DISTINCT o_orderkey AS commit, o_custkey AS run FROM orders WHERE o_orderkey % 5 = 0")
def commit_runs(spark, sf):
    links = _links(spark, sf)
    return runs.runs_of_commit(links, links.filter("commit % 5 = 0"))


@query(_LK + "SELECT run, l_linenumber AS name, min(l_partkey) AS hash FROM cr JOIN lineitem ON l_orderkey = commit GROUP BY ALL")
def run_weights(spark, sf):
    manifests = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("name")).agg(F.min("l_partkey").alias("hash"))
    return runs.weights_of_run(_links(spark, sf), manifests, _asked(spark, sf))


@query("SELECT c_custkey AS run FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unlinked_runs(spark, sf):
    return runs.unlinked(_links(spark, sf), _asked(spark, sf))


@query("SELECT user_id AS run, event_type AS key, arg_max(value, event_id) AS last, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY ALL")
def run_summary(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "value", F.col("event_id").alias("step"))
    return runs.run_summary(rows)


_BT = f"WITH {V.CHECKPOINTS_SQL}, b AS (SELECT *, max(loss) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb, max(loss) OVER (PARTITION BY run ORDER BY seq) AS best_value FROM cp) "


@query(_BT + "SELECT run, seq, bb IS NULL OR loss > bb AS best, step % 30 = 0 AS due, best_value, bb IS NULL OR loss > bb OR step % 30 = 0 AS save FROM b")
def best_tracking(spark, sf):
    rows = V.checkpoints(spark, sf).withColumnRenamed("loss", "metric")
    return runs.tracked(rows, 30, "max").select("run", "seq", "best", "due", "best_value", "save")


_REC = _C + ", rec AS (SELECT run, seq, step, epoch, loss, is_best, min(loss) OVER (PARTITION BY run ORDER BY seq) AS best, step % 50 = 0 OR epoch % 5 = 0 OR is_best AS save FROM b) "


@query(_REC + "SELECT run, seq, step, epoch, loss, is_best, best FROM rec WHERE save")
def checkpoint_records(spark, sf):
    return history.recorded(V.checkpoints(spark, sf))


@query(_REC + "SELECT run, seq, step, epoch, is_best FROM rec WHERE save AND is_best")
def best_checkpoint_list(spark, sf):
    return history.listed(history.recorded(V.checkpoints(spark, sf)), True, False)


@query(_REC + "SELECT run, arg_min(seq, {'l': loss, 's': seq}) AS seq FROM rec WHERE save GROUP BY run")
def best_checkpoint_loaded(spark, sf):
    return history.chosen(history.recorded(V.checkpoints(spark, sf)), best=True).select("run", "seq")


@query(_REC + "SELECT run, coalesce(max(seq) FILTER (run % 2 = 0 AND seq = 1), max(seq)) AS seq FROM rec WHERE save GROUP BY run")
def checkpoint_loaded(spark, sf):
    records = history.recorded(V.checkpoints(spark, sf))
    return history.chosen(records, records.filter("run % 2 = 0 and seq = 1")).select("run", "seq")


@query(_REC + "SELECT run, seq, loss FROM rec WHERE save AND run = 3 AND seq = (SELECT min(seq) FROM rec WHERE save AND run = 3)")
def checkpoint_info(spark, sf):
    records = history.recorded(V.checkpoints(spark, sf)).filter("run = 3")
    return records.orderBy("seq").limit(1).select("run", "seq", "loss")


@query("SELECT event_type AS model, arg_max(event_id, {'t': ts, 'i': event_id}) AS id, max(ts) AS at FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def latest_publishes(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_id") % 5 != 0).alias("ok"))
    return runs.newest_publish(rows)


@query("SELECT event_id AS id, '# ' || event_type || chr(10) || chr(10) || '- commit: ' || user_id || chr(10) || '- registry: unknown' || chr(10) || '- tensors: ' || event_id % 9 AS card FROM events")
def model_cards(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.col("user_id").alias("commit"), F.lit(None).cast("string").alias("registry"), (F.col("event_id") % 9).alias("tensors"))
    return runs.model_card(rows)


@query("SELECT label AS grp, count(*) AS tensors, sum(len(embedding))::BIGINT AS params, coalesce(sum(len(embedding)) FILTER (vec_id % 2 = 0), 0)::BIGINT AS trainable FROM embeddings GROUP BY 1")
def training_summary(spark, sf):
    model = V.base_model(spark, sf)
    size = F.size("values").cast("long")
    return model.groupBy("grp").agg(F.count("name").alias("tensors"), F.sum(size).alias("params"), F.coalesce(F.sum(F.when(F.col("name") % 2 == 0, size)), F.lit(0)).alias("trainable"))


@query("SELECT count(*) AS tensors, count(*) FILTER (vec_id % 4 = 0) AS loaded, sum(len(embedding) * 4)::BIGINT AS total_bytes, (sum(len(embedding) * 4) FILTER (vec_id % 4 = 0))::BIGINT AS loaded_bytes, round(sum(len(embedding) * 4) FILTER (vec_id % 4 = 0) / 100000.0, 6) AS used FROM embeddings")
def memory_stats(spark, sf):
    model = V.base_model(spark, sf).withColumn("loaded", F.col("name") % 4 == 0)
    return store.memory_stats(model, 100_000).select("tensors", "loaded", "total_bytes", "loaded_bytes", r6("used"))


# --- commits and references


@query(f"WITH {V.EDGES_SQL}, p AS (SELECT p_partkey AS commit, count(parent) AS n FROM part LEFT JOIN edges ON child = p_partkey GROUP BY 1) SELECT commit, n > 1 AS is_merge, n = 0 AS is_root FROM p")
def commit_kinds(spark, sf):
    commits = V.table(spark, sf, "part").select(F.col("p_partkey").alias("commit"))
    return history.kinds(commits, V.edges(spark, sf))


@query(_R.replace("starts(src) AS (VALUES (1500::BIGINT), (1501), (747))", "starts(src) AS (VALUES (1500::BIGINT))") + """, d AS (SELECT src, src AS node, 0 AS depth FROM starts UNION SELECT src, parent, depth + 1 FROM d JOIN edges ON child = node), m AS (SELECT node, min(depth) AS depth FROM d GROUP BY node),
  w AS (SELECT 1::BIGINT AS node, (SELECT depth FROM m WHERE node = 1) AS depth UNION ALL SELECT q.child, q.depth FROM (SELECT e.child, m.depth, row_number() OVER (ORDER BY e.child) AS place FROM w JOIN edges e ON e.parent = w.node JOIN m ON m.node = e.child AND m.depth = w.depth - 1) q WHERE place = 1)
  SELECT (SELECT max(depth) FROM w) - depth AS step, node FROM w WHERE depth IS NOT NULL""")
def commit_path_nodes(spark, sf):
    return history.path(V.edges(spark, sf), spark.createDataFrame([(1, 1500)], "a long, b long")).select("step", "node")


@query(_M + "SELECT name, hash FROM m1 WHERE name % 13 = 0")
def weights_at_ref(spark, sf):
    """Some names' tensors of the manifest that a branch names."""
    _, ours, _ = _manifests(spark, sf)
    refs = spark.createDataFrame([("main", "c1", "branch"), ("c1", "c1", "commit")], "name string, commit string, kind string")
    commit = store.resolve(refs, spark.createDataFrame([("main",)], "ref string"))
    return ours.withColumn("commit", F.lit("c1")).join(commit, "commit").filter("name % 13 = 0").select("name", "hash")


@query("WITH w AS (SELECT 'br' || (c_custkey % 50) AS name, c_custkey AS version, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS commit FROM customer), m AS (SELECT name, max(version) AS version FROM w GROUP BY name) SELECT name, commit FROM w JOIN m USING (name, version) WHERE commit IS NOT NULL")
def branch_table(spark, sf):
    rows = V.table(spark, sf, "customer").select(F.concat(F.lit("br"), F.col("c_custkey") % 50).alias("name"), F.lit("branch").alias("kind"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("commit"), F.col("c_custkey").alias("version"))
    return store.newest_refs(rows).select("name", "commit")


@query("SELECT o_orderkey, left(sha256(o_orderpriority || ':' || o_custkey), 16) AS version_id, o_orderpriority AS name, o_totalprice AS loss FROM orders")
def version_tags(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("commit"), F.create_map(F.lit("loss"), F.col("o_totalprice")).alias("metrics"))
    return store.versions(rows).select("o_orderkey", "version_id", "name", runs.metric(F.col("metrics"), "loss").alias("loss"))


# --- embedded functions


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, o_orderdate::TIMESTAMP AS back FROM orders")
def commit_times(spark, sf):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return V.table(spark, sf, "orders").select("o_orderkey", iso.alias("iso"), F.date_format(at, "yyyyMMdd_HHmmss").alias("stamp"), F.to_timestamp_ntz(iso).alias("back"))


@query("SELECT event_id, value AS loss, coalesce(CASE WHEN event_id % 2 = 0 THEN value * 2 END, -1.0::DOUBLE) AS extra, (2 + (event_id % 2 = 0)::INT)::INT AS keys, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM events")
def metric_maps(spark, sf):
    """Maps of metrics: the right one wins, numbers only, a default for what is missing."""
    even = F.col("event_id") % 2 == 0
    left = F.create_map(F.lit("loss"), F.lit("7"), F.lit("note"), F.lit("text"), F.lit("flag"), F.when(even, "true").otherwise("false"))
    right = F.when(even, F.create_map(F.lit("loss"), F.col("value").cast("string"), F.lit("extra"), (F.col("value") * 2).cast("string"))).otherwise(F.create_map(F.lit("loss"), F.col("value").cast("string")))
    numbers = runs.numeric(X.merged(left, right))
    rows = V.table(spark, sf, "events").withColumn("m", numbers)
    return rows.select("event_id", runs.metric(F.col("m"), "loss").alias("loss"), runs.metric(F.col("m"), "extra", -1.0).alias("extra"), F.size("m").alias("keys"), runs.metric(F.col("m"), "flag").alias("flag"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'conv' ELSE 'bias' END AS layer, CASE p_partkey % 3 WHEN 2 THEN 'bias' ELSE 'main/block' || p_partkey END AS path FROM part")
def layer_types(spark, sf):
    k = F.col("p_partkey") % 3
    n = F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("main.block"), n, F.lit(".linear2.weight"))).when(k == 1, F.concat(F.lit("main.block"), n, F.lit(".conv1.weight"))).otherwise("bias")
    rows = V.table(spark, sf, "part").withColumn("name", name)
    parts = F.split("name", r"\.")
    return rows.select("p_partkey", X.layer_type(F.col("name")).alias("layer"), F.replace(F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 2)), "."), F.lit("."), F.lit("/")).alias("path"))


@query("SELECT o_orderkey, '{\"name\":\"w' || o_orderkey || '\",\"shape\":[' || o_custkey || ',4]}' AS text, (o_custkey * 4)::BIGINT AS size FROM orders")
def metadata_json(spark, sf):
    """Metadata as JSON text and read back."""
    shape = F.array(F.col("o_custkey").cast("long"), F.lit(4).cast("long"))
    text = F.to_json(F.struct(F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("name"), shape.alias("shape")))
    back = F.from_json("text", "name string, shape array<bigint>")
    return V.table(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn("size", S.element_count(back["shape"]))


@query("SELECT 'refs/heads/' || o_orderpriority AS ref, o_orderpriority AS branch, count(*) AS n FROM orders GROUP BY ALL")
def stripped_refs(spark, sf):
    ref = F.concat(F.lit("refs/heads/"), F.col("o_orderpriority"))
    rows = V.table(spark, sf, "orders").select(ref.alias("ref"))
    return rows.groupBy("ref", F.replace("ref", F.lit("refs/heads/"), F.lit("")).alias("branch")).agg(F.count("ref").alias("n"))


@query(_W + "SELECT name, (list_sum(list_transform(v[1:8], lambda x, i: CASE WHEN x >= 0 THEN (1 << (8 - i)::INT) ELSE 0 END)))::INT AS first_byte FROM base")
def packed_signs(spark, sf):
    """Sign bitmaps, highest bit first; the first byte."""
    return V.base_model(spark, sf).select("name", F.aggregate(F.transform(F.slice("values", 1, 8), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1), 7 - i)).otherwise(0)), F.lit(0), lambda a, x: a + x).alias("first_byte"))


@query(_W + "SELECT name, (len(v) // 8)::INT AS n_rows, round(v[8 * 2 + 3 + 1], 6) + 0.0 AS cell, round(list_sum(list_concat(v, v[1:2])), 6) + 0.0 AS joined, v[1]::FLOAT::DOUBLE AS single FROM base")
def reshaped(spark, sf):
    """A flat tensor seen as rows of 8: row count, cell (2, 3), itself with its first two values appended, and a cast."""
    v = F.col("values")
    return V.base_model(spark, sf).select("name", F.floor(F.size(v) / 8).cast("int").alias("n_rows"), (F.round(F.element_at(v, 2 * 8 + 3 + 1), 6) + 0.0).alias("cell"), (F.round(S.total(F.concat(v, F.slice(v, 1, 2))), 6) + 0.0).alias("joined"), F.element_at(v, 1).cast("float").cast("double").alias("single"))
