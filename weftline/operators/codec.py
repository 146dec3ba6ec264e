"""Encoding one tensor against another. A pair table has `name, va, vb` (reference and tensor) as arrays of doubles.

Plain arithmetic codecs are column expressions; bit streams and byte compression are Arrow UDFs over whole batches.
Only the XOR codec is bit-exact; differences of floats don't add back exactly in general.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import similarity as S

KINDS = ("raw", "int8", "int16", "sparse", "compressed", "xor_float32", "xor_bfloat16", "exponent_mantissa", "per_axis")
#: Kinds that give every bit back (for 32-bit floats).
LOSSLESS = ("xor_float32", "xor_bfloat16")
OVERHEAD = 200


def delta(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: y - x)


def quantize(pairs: DataFrame, bits: int = 8) -> DataFrame:
    """`codes, scale, low`: the difference in 2**bits even steps over its range (all codes 0 where it is constant)."""
    d = pairs.withColumn("d", delta(F.col("va"), F.col("vb")))
    low, high = F.array_min("d"), F.array_max("d")
    scaled = d.withColumns({"low": low, "scale": (high - low) / float(2**bits - 1)})
    code = F.when(F.col("scale") > 0, F.transform("d", lambda x: F.least(F.lit(2**bits - 1), F.floor((x - F.col("low")) / F.col("scale") + 0.5)).cast("int"))).otherwise(F.transform("d", lambda x: F.lit(0)))
    return scaled.withColumn("codes", code).drop("d")


def dequantize(coded: DataFrame) -> DataFrame:
    return coded.withColumn("restored", F.zip_with("va", "codes", lambda x, c: x + c * F.col("scale") + F.col("low")))


def sparse(pairs: DataFrame, least: float = 1e-6) -> DataFrame:
    """`items`: positions (from 0) and values of differences larger than `least`."""
    numbered = F.transform(delta(F.col("va"), F.col("vb")), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("x")))
    return pairs.withColumn("items", F.filter(numbered, lambda e: F.abs(e["x"]) > least))


def from_sparse(coded: DataFrame) -> DataFrame:
    return coded.withColumn("restored", _scatter("va", F.transform("items", lambda e: e["pos"]), F.transform("items", lambda e: e["x"])))


def gaps(coded: DataFrame) -> DataFrame:
    """Positions of sparse items as first position and differences."""
    pos = F.transform("items", lambda e: e["pos"])
    return coded.withColumn("gaps", F.transform(pos, lambda p, i: F.when(i == 0, p).otherwise(p - F.element_at(pos, F.greatest(i, F.lit(1))))))


def from_gaps(coded: DataFrame) -> DataFrame:
    return coded.withColumn("positions", _running("gaps"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scatter(values: pd.Series, positions: pd.Series, added: pd.Series) -> pd.Series:
    out = []
    for v, p, x in zip(values, positions, added, strict=True):
        v = None if v is None else np.array(v, float)
        if v is not None and p is not None and len(p):
            v[np.asarray(p, np.int64)] += np.asarray(x, float)
        out.append(v)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running(gaps: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else np.cumsum(np.asarray(g, np.int64)) for g in gaps], dtype=object)


@F.pandas_udf(T.BinaryType())
def _xor(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            bits = np.asarray(x, np.float32).view(np.uint32) ^ np.asarray(y, np.float32).view(np.uint32)
            high, low = (bits >> 23).astype(np.uint16).tobytes(), (bits & 0x7FFFFF).astype(np.uint32).tobytes()
            first = zlib.compress(high, 6)
            out.append(len(first).to_bytes(8, "little") + first + zlib.compress(low, 6))
        yield pd.Series(out)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unxor(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, data in batches:
        out = []
        for x, d in zip(a, data, strict=True):
            n = int.from_bytes(d[:8], "little")
            bits = np.frombuffer(zlib.decompress(d[8 : 8 + n]), np.uint16).astype(np.uint32) << 23 | np.frombuffer(zlib.decompress(d[8 + n :]), np.uint32)
            out.append((np.asarray(x, np.float32).view(np.uint32) ^ bits).view(np.float32))
        yield pd.Series(out)


def xor_encode(pairs: DataFrame) -> DataFrame:
    """Bit-exact for 32-bit floats: exponents and mantissas of a XOR b, compressed apart."""
    return pairs.withColumn("data", _xor(F.col("va").cast("array<float>"), F.col("vb").cast("array<float>")))


def xor_decode(coded: DataFrame) -> DataFrame:
    return coded.withColumn("restored", _unxor(F.col("va").cast("array<float>"), F.col("data")))


@F.pandas_udf(T.BinaryType())
def _deflate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([zlib.compress((np.asarray(y, np.float32) - np.asarray(x, np.float32)).tobytes(), 6) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _inflate(values: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(x, np.float32) + np.frombuffer(zlib.decompress(d), np.float32) for x, d in zip(values, data, strict=True)])


def compressed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("data", _deflate("va", "vb"))


def decompressed(coded: DataFrame) -> DataFrame:
    return coded.withColumn("restored", _inflate("va", "data"))


def raw(pairs: DataFrame) -> DataFrame:
    """`d`: the difference in single precision."""
    return pairs.withColumn("d", delta(F.col("va"), F.col("vb")).cast("array<float>"))


def from_raw(coded: DataFrame) -> DataFrame:
    return coded.withColumn("restored", F.zip_with("va", "d", lambda x, d: x + d))


def _streams(*parts: bytes) -> bytes:
    """Byte streams compressed one by one, each with its length before it."""
    packed = [zlib.compress(p, 6) for p in parts]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def _unstreams(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(zlib.decompress(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def _bits(x) -> np.ndarray:
    return np.asarray(x, np.float32).view(np.uint32)


def encode_one(kind: str, a, b, columns: int | None = None) -> bytes:
    """Payload of tensor `b` against reference `a` (equal length); any of KINDS. `columns`: row width for per_axis."""
    if kind in ("xor_float32", "xor_bfloat16"):
        bits, cut = _bits(a) ^ _bits(b), 23 if kind == "xor_float32" else 16
        return _streams((bits >> cut).astype(np.uint16).tobytes(), (bits & ((1 << cut) - 1)).astype(np.uint32 if cut == 23 else np.uint16).tobytes())
    d = (np.asarray(b, float) - np.asarray(a, float)).astype(np.float32)
    if kind == "raw":
        return d.tobytes()
    if kind == "compressed":
        return zlib.compress(d.tobytes(), 6)
    if kind == "exponent_mantissa":
        bits = _bits(d)
        return _streams(np.packbits((bits >> 31).astype(np.uint8)).tobytes(), (bits >> 23 & 0xFF).astype(np.uint8).tobytes(), (bits & 0x7FFFFF).astype(np.uint32).tobytes())
    if kind == "sparse":
        at = np.flatnonzero(np.abs(d) > 1e-6)
        return np.diff(at, prepend=0).astype(np.int64).tobytes() + d[at].tobytes()
    if kind in ("int8", "int16"):
        top = (1 << int(kind[3:])) - 1
        low, high = (float(d.min()), float(d.max())) if len(d) else (0.0, 0.0)
        scale = (high - low) / top
        codes = np.floor((d.astype(float) - low) / scale + 0.5) if scale > 0 else np.zeros(len(d))
        return np.array([low, scale]).tobytes() + np.minimum(codes, top).astype(np.uint8 if kind == "int8" else np.uint16).tobytes()
    if kind == "per_axis":
        width = columns or max(1, len(d))
        m = np.abs(d).astype(float)
        m = np.append(m, np.full(-len(m) % width, np.nan)).reshape(-1, width)
        rows = np.nan_to_num(np.nanmean(m, axis=1)).astype(np.float16) if len(d) else np.zeros(0, np.float16)
        flat = rows.astype(float)[:, None]
        cols = np.nan_to_num(np.nanmean(np.where(flat > 0, m / np.where(flat > 0, flat, 1), np.where(np.isnan(m), np.nan, 0.0)), axis=0)).astype(np.float16) if len(d) else np.zeros(0, np.float16)
        return np.array([len(rows), len(cols)], np.int64).tobytes() + rows.tobytes() + cols.tobytes() + np.packbits(d >= 0).tobytes()
    raise ValueError(f"unknown kind {kind}")


def decode_one(kind: str, a, data: bytes) -> np.ndarray:
    """The tensor that `encode_one` took; single precision for the XOR kinds, else double."""
    if kind in ("xor_float32", "xor_bfloat16"):
        high, low = _unstreams(data)
        cut = 23 if kind == "xor_float32" else 16
        bits = np.frombuffer(high, np.uint16).astype(np.uint32) << cut | np.frombuffer(low, np.uint32 if cut == 23 else np.uint16).astype(np.uint32)
        return (_bits(a) ^ bits).view(np.float32)
    a = np.asarray(a, float)
    n = len(a)
    if kind == "raw":
        return a + np.frombuffer(data, np.float32)
    if kind == "compressed":
        return a + np.frombuffer(zlib.decompress(data), np.float32)
    if kind == "exponent_mantissa":
        sign, exponent, mantissa = _unstreams(data)
        bits = np.unpackbits(np.frombuffer(sign, np.uint8), count=n).astype(np.uint32) << 31 | np.frombuffer(exponent, np.uint8).astype(np.uint32) << 23 | np.frombuffer(mantissa, np.uint32)
        return a + bits.view(np.float32)
    if kind == "sparse":
        k = len(data) // 12
        out = a.copy()
        out[np.cumsum(np.frombuffer(data[: 8 * k], np.int64))] += np.frombuffer(data[8 * k :], np.float32)
        return out
    if kind in ("int8", "int16"):
        low, scale = np.frombuffer(data[:16])
        return a + low + scale * np.frombuffer(data[16:], np.uint8 if kind == "int8" else np.uint16)
    if kind == "per_axis":
        r, c = np.frombuffer(data[:16], np.int64)
        rows, cols = np.frombuffer(data[16 : 16 + 2 * r], np.float16).astype(float), np.frombuffer(data[16 + 2 * r : 16 + 2 * (r + c)], np.float16).astype(float)
        sign = np.unpackbits(np.frombuffer(data[16 + 2 * (r + c) :], np.uint8), count=n).astype(float) * 2 - 1
        return a + sign * np.outer(rows, cols).ravel()[:n]
    raise ValueError(f"unknown kind {kind}")


def encode(pairs: DataFrame, kind: str, columns: int | None = None) -> DataFrame:
    """Adds `data`, the payload of `vb` against `va`; null where their lengths differ."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or len(x) != len(y) else encode_one(kind, x, y, columns) for x, y in zip(a, b, strict=True)], dtype=object)

    return pairs.withColumn("data", run("va", "vb"))


def decode(coded: DataFrame) -> DataFrame:
    """Adds `restored` from `va`, `kind` and `data`; rows without data keep null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(kind: pd.Series, a: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or d is None else decode_one(k, x, d).astype(float) for k, x, d in zip(kind, a, data, strict=True)], dtype=object)

    return coded.withColumn("restored", run("kind", "va", "data"))


def round_trips(pairs: DataFrame, kinds: tuple[str, ...] = LOSSLESS) -> DataFrame:
    """Adds `restored`, a struct with what each kind gives back of `vb`: encoded, and decoded from that payload; null where lengths differ.

    All kinds and both ways are one call, so a task has one Python worker; `encode` and `decode` one after the other have one each.
    """
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kind {min(unknown)}")

    @F.pandas_udf(T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in kinds]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        back = lambda kind, x, y: None if x is None or y is None or len(x) != len(y) else decode_one(kind, x, encode_one(kind, x, y)).astype(float)
        for a, b in batches:
            yield pd.DataFrame({k: pd.Series([back(k, x, y) for x, y in zip(a, b, strict=True)], dtype=object) for k in kinds})

    return pairs.withColumn("restored", run("va", "vb"))


def stored_bytes(data: Column, meta: Column) -> Column:
    """Bytes that a delta takes: payload, metadata as JSON, and a fixed overhead."""
    return (F.length(data) + F.length(meta) + OVERHEAD).cast("long")


def with_dictionary(cells: DataFrame, size: int = 256) -> DataFrame:
    """Each cell's `code` in the dictionary of the most frequent values, or null and the value itself as `literal`."""
    top = dictionary(cells, size)
    return cells.join(F.broadcast(top.select("x", "code")), "x", "left").withColumn("literal", F.when(F.col("code").isNull(), F.col("x")))  # `size` rows


def from_dictionary(coded: DataFrame, top: DataFrame) -> DataFrame:
    return coded.drop("x").join(F.broadcast(top.select("code", F.col("x").alias("known"))), "code", "left").withColumn("x", F.coalesce("literal", "known")).drop("known")


def per_axis(pairs: DataFrame, columns: int) -> DataFrame:
    """Signs with a mean size for each row and each column of the tensor seen as rows of `columns` values."""
    cells = pairs.select("name", F.posexplode(delta(F.col("va"), F.col("vb"))).alias("pos", "d"))
    cells = cells.withColumns({"r": F.floor(F.col("pos") / columns), "c": F.col("pos") % columns, "sign": F.when(F.col("d") >= 0, 1).otherwise(-1)})
    rows = cells.groupBy("name", "r").agg(F.avg(F.abs("d")).alias("row_scale"))
    cells = cells.join(rows, ["name", "r"])
    cols = cells.groupBy("name", "c").agg(F.avg(F.when(F.col("row_scale") > 0, F.abs("d") / F.col("row_scale")).otherwise(0.0)).alias("col_scale"))
    return cells.join(cols, ["name", "c"]).select("name", "pos", (F.col("sign") * F.col("row_scale") * F.col("col_scale")).alias("restored"))


def statistics(pairs: DataFrame, bins: int = 256) -> DataFrame:
    """Of each difference: mean, spread, extremes, share near zero, entropy of an even histogram, and the codec that suits."""
    cells = pairs.select("name", F.explode(delta(F.col("va"), F.col("vb"))).alias("d"))
    stats = cells.groupBy("name").agg(
        F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("low"), F.max("d").alias("high"),
        F.avg((F.abs("d") < 1e-6).cast("double")).alias("sparsity"), F.count("d").alias("n"),
    )
    width = F.col("high") - F.col("low")
    slot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("d") - F.col("low")) / width * bins))).otherwise(0)
    held = cells.join(stats.select("name", "low", "high"), "name").groupBy("name", slot.alias("slot")).agg(F.count("d").alias("k"))
    p = F.col("k") / F.sum("k").over(_by_name())
    entropy = held.withColumn("p", p).groupBy("name").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    codec = (
        F.when(F.col("sparsity") > 0.7, "sparse").when((width < 2) & (F.col("std") < 0.1), "int8").when(width < 100, "int16").when(F.col("entropy") < 5, "compressed").otherwise("raw")
    )
    return stats.join(entropy, "name").withColumn("codec", codec)


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("name")


def dictionary(cells: DataFrame, size: int = 256) -> DataFrame:
    """`x, n, code`: the most frequent values of a column `x`; what isn't among them stays literal."""
    from pyspark.sql import Window

    top = cells.groupBy("x").agg(F.count("x").alias("n")).orderBy(F.desc("n"), "x").limit(size)
    return top.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "x")) - 1)


def estimated_bytes(pairs: DataFrame, kind: str) -> Column:
    n = F.size("va")
    if kind == "sparse":
        return (F.size(F.filter(delta(F.col("va"), F.col("vb")), lambda x: F.abs(x) > 1e-6)) * 8).cast("long")
    return (n * {"int8": 1, "int16": 2}.get(kind, 4)).cast("long")


def encodable(pairs: DataFrame, kind: str = "sparse", least_bytes: int = 512, least_ratio: float = 0.0) -> DataFrame:
    """`bytes, estimate, ok`: worth encoding if the tensor is large enough and the estimate saves `least_ratio`."""
    size = (F.size("vb") * 4).cast("long")
    out = pairs.withColumns({"bytes": size, "estimate": estimated_bytes(pairs, kind) + 2 * OVERHEAD})
    saved = 1.0 - F.col("estimate") / F.col("bytes")
    return out.withColumn("ok", (F.size("va") == F.size("vb")) & (F.col("bytes") >= least_bytes) & (saved > least_ratio))


def adaptive_quantize(pairs: DataFrame, bits: int = 8) -> DataFrame:
    """`codes, low, scale, outliers`: values clipped to mean ± 3 deviations, then even steps, halves rounded to even; empty stays empty."""
    d = pairs.withColumn("d", delta(F.col("va"), F.col("vb")))
    n = F.size("d")
    mean = S.total(F.col("d")) / n
    d = d.withColumn("mean", mean).withColumn("std", F.sqrt(S.total(F.transform("d", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n))
    d = d.withColumns({"low": F.col("mean") - 3 * F.col("std"), "high": F.col("mean") + 3 * F.col("std")})
    d = d.withColumn("scale", (F.col("high") - F.col("low")) / float(2**bits - 1))
    outside = F.size(F.filter("d", lambda x: (x < F.col("low")) | (x > F.col("high"))))
    clipped = F.transform("d", lambda x: F.least(F.greatest(x, F.col("low")), F.col("high")))
    codes = F.transform(clipped, lambda x: F.when(F.col("scale") > 0, F.rint((x - F.col("low")) / F.col("scale"))).otherwise(0.0).cast("int"))
    return d.withColumns({"outliers": F.when(n > 0, outside / n), "codes": codes}).drop("d", "mean", "std", "high")
