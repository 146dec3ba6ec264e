"""Small text and map expressions that the version-control surface needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(n: Column) -> Column:
    """One decimal in the largest unit that gives at least 1."""
    value = n.cast("double")
    out = F.concat(F.format_string("%.1f", value / 1024.0 ** (len(UNITS) - 1)), F.lit(" " + UNITS[-1]))
    for k in reversed(range(len(UNITS) - 1)):
        out = F.when(value < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", value / 1024.0**k), F.lit(" " + UNITS[k]))).otherwise(out)
    return out


def remote_kind(url: Column) -> Column:
    """s3 (also for minio), file, or null for a scheme that isn't known."""
    scheme = F.regexp_extract(url, r"^([a-z0-9]+)://", 1)
    return F.when(scheme.isin("s3", "minio"), "s3").when(scheme == "file", "file")


def remote_bucket(url: Column) -> Column:
    """Bucket of s3://bucket/..., second part of minio://host/bucket/..."""
    parts = F.split(F.regexp_replace(url, r"^[a-z0-9]+://", ""), "/")
    return F.when(F.startswith(url, F.lit("minio://")), F.get(parts, F.lit(1))).when(F.startswith(url, F.lit("s3://")), F.get(parts, F.lit(0)))


def layer_type(name: Column) -> Column:
    """Last but one part of a dotted parameter name, without trailing digits."""
    parts = F.split(name, r"\.")
    return F.regexp_replace(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1)), r"\d+$", "")


def merged(left: Column, right: Column) -> Column:
    """Two maps in one, the right one's values winning."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def commit_message(template: str, **columns: Column) -> Column:
    """`template` with {name} filled from columns."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
