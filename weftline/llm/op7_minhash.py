"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set holds the hashes of its 5-word shingles. K minima of it, b bits each, are its signature. Signatures are
cut into chunks of CHUNK values; by pigeonhole two signatures that differ in fewer than CHUNKS * (ERRORS + 1) values have
a chunk with ERRORS differing values at most. All ways of leaving ERRORS values of a chunk out are enumerated as keys, so
such pairs are certain to meet under a key. Links are confirmed on the full sets.

Equal sets are one node from the start. Under each key, nodes are first compared with one of them (a hub), which joins
large groups of near copies in about as many comparisons as they have nodes; then all pairs under a key whose ends are
still in different components are compared, so no link between components is missed and none inside one is spent on.
Sizes and signatures are tested before any text is read. Texts are read again only for pairs that pass (a bitmap of a
fixed size tells which), travel compressed, and become sets where they meet. Before the last step pairs must also be near
by LONG further minima, so documents that share a passage are told apart without their texts. A group of variants of one
text, of which many are just below the threshold, leaves pairs by the square of its size; the last step takes each pair
once, under the first key that it shares, and sends texts to blocks of such groups, not to pairs.

Defined results: null, empty and blank texts have no set, link with nothing and are their own component; a text with
fewer than 5 words has one shingle, its whole sequence; repeated rows are copies; a null id takes part in linking but
never names a component unless all ids of the component are null (the component is null then, and `kept` false). Very long
texts are handled whole; an empty table gives an empty result. Other columns than id and text are not carried, so
clashing names can't arise.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, read, release
from weftline.llm.components import components
from weftline.llm.words import Words, mixed, pieces, shingles

SHINGLE = 5
PERCENT = 70
CHUNK, CHUNKS, ERRORS = 4, 12, 1
K = CHUNK * CHUNKS
#: Nodes aren't compared with a hub above this signature distance; what is left out here still meets in `_crossing`.
HUB_DISTANCE = 31
#: Minima of the long signatures and the distance above which pairs are dropped: at the least similarity the chance is under 1e-7.
LONG, LONG_DISTANCE = 256, 121
#: Rows of a key that meet at once.
BLOCK = 2_048
#: Texts of a family of candidates that become sets at once, on either side.
SETS = 256
#: log2 of the bits of the map of texts to read again; 8 MB, whatever the input.
MAP_BITS = 26
_MULTIPLY = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_LONG_MULTIPLY = (np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, LONG, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minima of each row's hashes, 16 bits of each; rows must not be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, K), np.uint16)
    for k in range(K):
        low = np.minimum.reduceat(x * _MULTIPLY[k], first[:-1]) * np.uint32(0x9E3779B1)
        out[:, k] = (low >> np.uint32(16)).astype(np.uint16)
    return out


def _set_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes."""
    s = np.sort(hashes)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _text_hash(words: Words, row: int) -> int:
    import xxhash

    a, b = words.offsets[row], words.offsets[row + 1]
    return xxhash.xxh3_64_intdigest(words.raw[a:b]) - (1 << 63)


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: `id`, `n` (size of the set), `digest` of the set, `text_hash` and `signature`; the last three null without a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            words = Words(part.column(1))
            hashes, first = shingles(words, SHINGLE)
            rows = part.num_rows
            has = np.flatnonzero(np.diff(first) > 0)
            n, digest, text, signature = np.zeros(rows, np.int64), [None] * rows, [None] * rows, [None] * rows
            if len(has):
                made = _signatures(hashes, np.append(first[:-1][has], first[-1]))
                for i, row in enumerate(has.tolist()):
                    own = _set_of(hashes[first[row] : first[row + 1]])
                    n[row], digest[row] = len(own), hashlib.blake2b(own, digest_size=16).digest()
                    text[row], signature[row] = _text_hash(words, row), made[i].tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.array(text, pa.int64()), pa.array(signature, pa.binary())], names=["id", "n", "digest", "text_hash", "signature"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, digest binary, text_hash long, signature binary")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: every chunk with each of its values left out in turn."""
    values = signatures.astype(np.uint64).reshape(len(signatures), CHUNKS, CHUNK)
    keys = np.empty((len(signatures), CHUNKS, CHUNK), np.uint64)
    for out in range(CHUNK):
        packed = np.zeros((len(signatures), CHUNKS), np.uint64)
        for k in range(CHUNK):
            if k != out:
                packed = (packed << np.uint64(16)) | values[:, :, k]
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out)
        keys[:, :, out] = mixed(packed + (place[None, :] << np.uint64(48)))
    return keys.reshape(len(signatures), CHUNKS * CHUNK)


def _first_shared(one: np.ndarray, others: np.ndarray, chunk: int, out: int) -> np.ndarray:
    """Of signatures (a 64-bit number a chunk) that share the key of `chunk` without value `out`: whether no key before it is shared."""
    x = others[:, : chunk + 1] ^ one[: chunk + 1]
    earlier = np.zeros((len(x), chunk), np.bool_)
    for k in range(CHUNK):
        earlier |= x[:, :chunk] & ~np.uint64(0xFFFF << 16 * k) == 0
    return ~earlier.any(axis=1) & ((x[:, chunk] != 0) | (out == 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of `a, b` the pairs `a, b, ha, hb` (with text hashes) that sizes and signatures don't rule out: a cheap test before texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = (_matrix(part.column(4)) != _matrix(part.column(5))).sum(axis=1) <= HUB_DISTANCE
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near)) for k in range(4)], names=["a", "b", "ha", "hb"])

    x = nodes.select(F.col("node").alias("a"), F.col("text_hash").alias("ha"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    y = nodes.select(F.col("node").alias("b"), F.col("text_hash").alias("hb"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    met = pairs.join(x, "a").join(y, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return met.select("a", "b", "ha", "hb", "sa", "sb").mapInArrow(run, "a long, b long, ha long, hb long")


def _bitmap(hashes: DataFrame) -> bytes:
    """Bits of the hashes' leading MAP_BITS, gathered as 64-bit words: at most 2**(MAP_BITS - 6) rows whatever comes in."""
    top = F.shiftrightunsigned(F.col("text_hash"), 64 - MAP_BITS)
    words = hashes.groupBy(F.shiftright(top, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (top % 64).cast("int"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _reread(df: DataFrame, text_col: str, wanted: DataFrame, make: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """`text_hash, made` of the texts whose hashes are wanted, once each; `make` turns a column of texts into bytes."""
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bits.value, np.int64)
        seen: set[int] = set()
        for part in pieces(batches, 0):
            bare = Words(part.column(0), hashes=False)
            rows, found = [], []
            for row in np.flatnonzero(np.diff(bare.first)).tolist():
                h = _text_hash(bare, row)
                top = (h & 0xFFFFFFFFFFFFFFFF) >> (64 - MAP_BITS)
                if int(marked[top >> 6]) >> (top & 63) & 1 and h not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(h)
                    rows.append(row)
                    found.append(h)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(make(part.column(0).take(pa.array(rows))), pa.binary())], names=["text_hash", "made"])

    made = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "text_hash long, made binary")
    return made.groupBy("text_hash").agg(F.first("made").alias("made"))


def _packed(column: pa.Array) -> list[bytes]:
    """Texts, compressed: some three times smaller than the hashes of their shingles, which are made again where they meet."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=3, write_content_size=True)
    return [coder.compress(t.encode()) for t in column.to_pylist()]


def _sets_of(bodies: list[bytes]) -> list[np.ndarray]:
    import zstandard

    coder = zstandard.ZstdDecompressor()
    hashes, first = shingles(Words(pa.array([coder.decompress(b) for b in bodies], pa.binary()).cast(pa.string())), SHINGLE)
    return [_set_of(hashes[first[i] : first[i + 1]]) for i in range(len(bodies))]


def _long_signatures(column: pa.Array) -> list[bytes]:
    """LONG further minima of each text's shingles, 8 bits of each."""
    hashes, first = shingles(Words(column), SHINGLE)
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((len(first) - 1, LONG), np.uint8)
    for k in range(LONG):
        low = np.minimum.reduceat(x * _LONG_MULTIPLY[k], first[:-1]) * np.uint32(0x9E3779B1)
        out[:, k] = (low >> np.uint32(24)).astype(np.uint8)
    return [r.tobytes() for r in out]


def _confirmed(pairs: DataFrame, df: DataFrame, text_col: str, percent: int) -> DataFrame:
    """Of the pairs `a, b, ha, hb` those whose full sets are similar enough, as `a, b`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, other = None, np.zeros(0, np.uint64)
        for batch in batches:
            b, x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            keep = []
            for at in range(0, len(b), 64):
                for i, p in enumerate(_sets_of(x[at : at + 64]), at):
                    if b[i] != hub:  # rows come sorted by b, so a hub's set is made once for many
                        hub, other = b[i], _sets_of([y[i].as_py()])[0]
                    both = np.sort(np.concatenate([p, other]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(p) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("ha", "hb")).alias("text_hash")).distinct()
    texts = _reread(df, text_col, wanted, _packed)
    x, y = texts.select(F.col("text_hash").alias("ha"), F.col("made").alias("x")), texts.select(F.col("text_hash").alias("hb"), F.col("made").alias("y"))
    return pairs.join(x, "ha").join(y, "hb").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed_in_blocks(pairs: DataFrame, df: DataFrame, text_col: str, percent: int) -> DataFrame:
    """Like `_confirmed`, for pairs that outnumber their texts: `a, b` that join the same nodes as all similar pairs do.

    Nodes with the same least partner are a family; families of more than SETS nodes are cut into blocks. The pairs of two
    blocks are one unit, those of small families share units, and each unit gets every text it needs once. Of pairs that a
    unit has joined already none is returned.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    nodes = materialize(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("family")), "families")
    shared = max(1, nodes.count() // SETS)
    parts = nodes.groupBy("family").agg(F.ceil(F.count("node") / SETS).cast("int").alias("parts"))
    placed = nodes.join(parts, "family").select("node", "family", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    side = lambda end: placed.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("family", "parts", "part")))
    small = (F.col("parts_a") == 1) & (F.col("parts_b") == 1)
    bin_of = lambda family, n: F.pmod(F.xxhash64(family), F.lit(n))
    apart = F.when(F.col("family_a") != F.col("family_b"), bin_of("family_b", -(-shared // 64)))
    unit = F.when(small, F.xxhash64(bin_of("family_a", shared), F.coalesce(apart, F.lit(-1)))).otherwise(F.xxhash64("family_a", "part_a", "family_b", "part_b"))
    units = pairs.join(side("a"), "a").join(side("b"), "b").select(unit.alias("unit"), "a", "b", "ha", "hb")
    hashes = F.explode(F.array("ha", "hb")).alias("text_hash")
    texts = _reread(df, text_col, pairs.select(hashes).distinct(), _packed)
    needed = units.select(F.col("unit").alias("of"), hashes).distinct().join(texts, "text_hash")

    def meet(found: pa.Table, held: pa.Table) -> pa.Table:
        bodies, named = held.column("made").to_pylist(), held.column("text_hash").to_numpy()
        sets = [x for at in range(0, len(bodies), 64) for x in _sets_of(bodies[at : at + 64])]
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        kinds, item = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(named)
        found = found.sort_by([("ha", "ascending")])
        x, y = (order[np.searchsorted(named, found.column(c).to_numpy(), sorter=order)] for c in ("ha", "hb"))
        common = np.empty(len(x), np.int64)
        mark = np.zeros(len(kinds), np.bool_)
        edges = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1
        for low, high in zip(np.append(0, edges[:-1]).tolist(), edges.tolist(), strict=True):
            own = item[start[x[low]] : start[x[low]] + size[x[low]]]
            mark[own] = True
            for at in range(low, high, SETS):
                others = y[at : min(at + SETS, high)]
                first = np.cumsum(size[others]) - size[others]
                places = np.repeat(start[others] - first, size[others]) + np.arange(size[others].sum())
                common[at : at + len(others)] = np.add.reduceat(mark[item[places]].astype(np.int64), first)
            mark[own] = False
        similar = np.flatnonzero(100 * common >= percent * (size[x] + size[y] - common))
        above = list(range(len(sets)))

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        kept = []
        for k, i, j in zip(similar.tolist(), x[similar].tolist(), y[similar].tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                above[i] = j
                kept.append(k)
        return found.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return units.groupBy("unit").cogroup(needed.groupBy("of")).applyInArrow(meet, "a long, b long")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, `n_shingles`, `component_id`, `kept` and `text_hash` (null without words)."""
    rows = materialize(sketch(df, id_col, text_col), "sketches")
    nodes = rows.filter("n > 0").groupBy("digest").agg(F.min("text_hash").alias("text_hash"), F.min("signature").alias("signature"), F.min("n").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = _keyed(nodes)
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("top > hub").drop("top")
    met = materialize(keyed.join(hubs, "key"), "met")

    def confirm(pairs: DataFrame, test: Callable[..., DataFrame] = _confirmed) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        out = materialize(test(pairs, df, text_col, percent), "links")
        release(pairs)
        return out

    # each node with the hub that it shares most keys with, then a hub in each key where components still meet, then all that still meet
    often = met.filter("node <> hub").repartition("node").groupBy("node", "hub").agg(F.count("key").alias("keys"))
    links = [confirm(_alike(often.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("keys", F.negate("hub"))).alias("b")), nodes, percent))]
    found = components(links[0])
    open_ = materialize(_open(met.select("key", "node"), found), "open")
    release(met, found)
    hubs = open_.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node")).alias("hub"))
    pairs = open_.join(hubs, "key").filter(F.col("component") != F.col("hub.component"))
    pairs = pairs.groupBy(F.col("node").alias("a")).agg(F.min_by("hub.node", F.xxhash64("key")).alias("b"))
    links.append(confirm(_alike(pairs, nodes, percent)))
    found = components(links[0].unionByName(links[1]))
    still = materialize(_open(open_.select("key", "node"), found), "open")
    release(open_, found)
    if not still.isEmpty():
        links.append(confirm(_crossing(still, nodes, df, text_col, percent), _confirmed_in_blocks))
    release(still)
    found = components(functools.reduce(DataFrame.unionByName, links))
    release(*links)
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    placed = rows.join(named, "digest", "left")
    # documents without a set are components of their own, keyed by id; their rows never meet others
    names = placed.filter("component is not null").groupBy("component").agg(F.min("id").alias("name"))
    out = placed.join(names, "component", "left")
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("id") == name, F.lit(False)).alias("kept"), "text_hash")


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the keys under which nodes of different components meet: `key, node, component`."""
    labelled = met.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return labelled.join(keys.select("key"), "key")


def _crossing(open_: DataFrame, nodes: DataFrame, df: DataFrame, text_col: str, percent: int) -> DataFrame:
    """`a, b, ha, hb` of all pairs under a key that are in different components and whose long signatures are near.

    Rows outside the key's largest component (the minor ones) meet all rows of the key, in units of BLOCK minor rows and
    BLOCK others that are compared as arrays: a key of any size is just more units, and only near pairs leave them. Keys
    of one unit share tasks.
    """
    sized = open_.groupBy("key", "component").agg(F.count("node").alias("rows"))
    keys = sized.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))
    keys = keys.select("key", "largest", F.ceil(F.col("rows") / BLOCK).cast("int").alias("all"), F.ceil((F.col("rows") - F.col("most")) / BLOCK).cast("int").alias("minor"))
    wanted = nodes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text_hash", "n", "signature")
    long = _reread(df, text_col, wanted, _long_signatures).join(wanted, "text_hash")
    long = materialize(long.select("node", "text_hash", "n", "signature", F.col("made").alias("sig")), "long")
    rows = open_.join(long, "node").join(keys, "key")
    shared = max(1, open_.count() // 32_768)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    alone = (F.col("all") == 1) & (F.col("minor") == 1)
    unit = lambda i, j: F.when(alone, F.pmod(F.xxhash64("key"), F.lit(shared)).cast("string")).otherwise(F.concat_ws(":", "key", i, j))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["key", "node", "component", "n", "text_hash", "signature", "sig"]
    left = rows.filter("component <> largest").withColumn("other", others("all")).select(unit(block("minor"), "other").alias("unit"), F.lit(0).alias("side"), F.lit(False).alias("top"), *carried)
    right = rows.withColumn("other", others("minor")).select(unit("other", block("all")).alias("unit"), F.lit(1).alias("side"), (F.col("component") == F.col("largest")).alias("top"), *carried)

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("side", "ascending")])
        key, side, top, node, component, n, own = (table.column(c).to_numpy() for c in ("key", "side", "top", "node", "component", "n", "text_hash"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, LONG)
        short = _matrix(table.column("signature"))
        packed = short.astype("<u2").view("<u8")
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        p, q = [], []
        starts = np.append(0, ends[:-1])
        own_keys = (chunk_keys(short[starts]).view(np.int64) == key[starts][:, None]).argmax(axis=1)
        for start, stop, own_key in zip(starts.tolist(), ends.tolist(), own_keys.tolist(), strict=True):
            cut = start + int(np.searchsorted(side[start:stop], 1))
            r = np.arange(cut, stop)
            for i in range(start, cut):
                j = r[(component[r] != component[i]) & (top[r] | (node[r] > node[i])) & (100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i]))]
                j = j[_first_shared(packed[i], packed[j], *divmod(own_key, CHUNK))]
                j = j[np.count_nonzero(sig[j] != sig[i], axis=1) <= LONG_DISTANCE]
                p.append(np.full(len(j), i))
                q.append(j)
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (p, q))
        return pa.table({"a": node[p], "b": node[q], "ha": own[p], "hb": own[q]})

    return left.unionByName(right).groupBy("unit").applyInArrow(meet, "a long, b long, ha long, hb long")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spread AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS k FROM split),
runs AS (
  SELECT doc_id, i, k, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS item
  FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
held AS (SELECT DISTINCT doc_id, md5_number(item) AS item FROM runs WHERE i <= greatest(k - 4, 1)),
counted AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
sized AS (SELECT split.doc_id, coalesce(n, 0)::BIGINT AS n FROM split LEFT JOIN counted USING (doc_id)),
items AS (SELECT doc_id, n, item FROM held JOIN counted USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 70 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sized UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
named AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN named ON doc_id = node
"""
