"""Vector functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where the lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))


def normalize(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))


def stub_embedding(text: Column, dim: int) -> Column:
    """Bag of tokens: each token adds one at the first byte of its SHA-256 modulo dim."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    at = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 2), 16, 10).cast("int") % dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double"))
