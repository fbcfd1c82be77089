"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for different lengths."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(0.0))


def hashed_embedding(text: Column, buckets: int = 64) -> Column:
    """Counts of a text's lower-case words of a-z and 0-9 over ``buckets`` hashed buckets: a deterministic stand-in for an embedding model. Null is as empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    places = F.array(F.transform(words, lambda w: F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(buckets)).cast("int")))
    counts = lambda p: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double"))
    return F.get(F.transform(places, counts), F.lit(0))
