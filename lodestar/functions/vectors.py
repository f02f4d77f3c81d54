"""Vectors as arrays of numbers, in native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digests behind a hash embedding; eight numbers each.
SEEDS = 48


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), zero, lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    """The length of a vector, 1 for the zero vector."""
    n = F.sqrt(F.aggregate(F.transform(a.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def hash_embedding(text: Column) -> Column:
    """384 numbers of length 1 from SHA-256: of the text, then of that digest and each seed."""
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    seeds = F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda s: F.sha2(F.concat(digest, F.unhex(F.lpad(F.hex(s), 8, "0"))), 256))
    raw = F.flatten(F.transform(seeds, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _signed(F.substring(h, i * 8 + 1, F.lit(8))))))
    return F.transform(F.arrays_zip(raw.alias("v"), F.array_repeat(l2_norm(raw), SEEDS * 8).alias("n")), lambda z: z["v"] / z["n"])


def _signed(word: Column) -> Column:
    """A hexadecimal word as a signed 32-bit number."""
    n = F.conv(word, 16, 10).cast("double")
    return F.when(n >= 2147483648.0, n - 4294967296.0).otherwise(n)
