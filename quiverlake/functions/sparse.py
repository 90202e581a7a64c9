"""Sparse vectors: map<int, float>. Scalar products need no join for two maps; collections use the exploded form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import total


def _col(m: Column | str) -> Column:
    return F.col(m) if isinstance(m, str) else m


def magnitude(m: Column | str) -> Column:
    return F.sqrt(total(F.transform(F.map_values(_col(m)), lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the dimensions that both have."""
    zipped = F.map_zip_with(_col(a), _col(b), lambda _, x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return total(F.map_values(zipped))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 where either has magnitude 0."""
    n = magnitude(a) * magnitude(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine_similarity(a, b)


def jaccard_similarity(a: Column | str, b: Column | str) -> Column:
    """Of the dimensions; two empty vectors are alike, an empty one is like no other."""
    ka, kb = F.map_keys(_col(a)), F.map_keys(_col(b))
    return F.when((F.size(ka) == 0) & (F.size(kb) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(ka, kb)) / F.size(F.array_union(ka, kb)))


def is_valid(m: Column | str) -> Column:
    """Not empty, no NaN and no infinity; zeros and negative numbers may be stored."""
    bad = F.exists(F.map_values(_col(m)), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(_col(m)) > 0) & ~bad, F.lit(False))


def get(m: Column | str, dim: int) -> Column:
    return F.coalesce(F.element_at(_col(m), F.lit(dim)), F.lit(0.0))


def insert(m: Column | str, dim: int, value: float) -> Column:
    kept = F.map_filter(_col(m), lambda k, _: k != dim)
    return F.map_concat(kept, F.create_map(F.lit(dim), F.lit(value).cast("float")))
