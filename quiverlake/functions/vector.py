"""Vector arithmetic as expressions. Vectors are arrays of floats; everything is computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(_pairs(a, b, lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """One less the inner product: for vectors of norm 1."""
    return 1 - dot(a, b)


def cosine_normalizing(a: Column | str, b: Column | str) -> Column:
    """For vectors of any norm; 1 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Negated, so that ascending is best."""
    return -dot(a, b)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places where one component is over 0.5 and the other isn't."""
    return F.size(F.filter(_pairs(a, b, lambda x, y: (x > 0.5) != (y > 0.5)), lambda d: d)).cast("double")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of the sets of places over 0.5; two empty sets are at distance 0."""
    both = F.size(F.filter(_pairs(a, b, lambda x, y: (x > 0.5) & (y > 0.5)), lambda d: d))
    either = F.size(F.filter(_pairs(a, b, lambda x, y: (x > 0.5) | (y > 0.5)), lambda d: d))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)


#: Distances by name, ascending is nearest. Add to it with ``register_metric``.
METRICS: dict[str, Metric] = {"l2": l2, "cosine": cosine, "cosine_any": cosine_normalizing, "ip": inner_product, "hamming": hamming, "jaccard": jaccard}


def register_metric(name: str, metric: Metric) -> None:
    METRICS[name] = metric


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"no metric {name}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def normalize(v: Column | str) -> Column:
    """To norm 1; a zero vector stays zero."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(_col(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))[0]


def is_valid(v: Column | str) -> Column:
    """Not empty, and finite throughout."""
    v = _col(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def binarize(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: F.when(x > 0, 1.0).otherwise(0.0))


def convert(distance: Column, source: str, target: str) -> Column:
    """A distance under another metric, where that needs no vectors: the same metric, or inner product and cosine for
    values from -1 to 1. Null where it has to be computed again."""
    if source == target:
        return distance
    if {source, target} == {"ip", "cosine"}:
        return F.when(distance.between(-1, 1), 1 - distance)
    return F.lit(None).cast("double")


def same(a: Column | str, b: Column | str, tolerance: float = 1e-6) -> Column:
    """Of one length, and every component within the tolerance."""
    close = F.forall(_pairs(a, b, lambda x, y: F.abs(x - y)), lambda d: F.coalesce(d < tolerance, F.lit(False)))
    return (F.size(_col(a)) == F.size(_col(b))) & close


def near(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Cosine similarity of at least the threshold. Two zero vectors are near, a zero and another are not."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) & (nb == 0), True).when((na == 0) | (nb == 0), False).otherwise(dot(a, b) / (na * nb) >= threshold)
