"""Metadata filters as a tree of conditions.

Logic is two-valued: a condition on a missing value is false, so its negation is true. ``column`` is true or false for
every row; ``where`` may be null instead of false, as a filter allows, and its comparisons reach the scan. An empty ``And`` lets all rows pass, an empty ``Or`` none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Filter:
    def column(self) -> Column:
        raise NotImplementedError

    def where(self) -> Column:
        return self.column()

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)

    def of(self, df: DataFrame) -> DataFrame:
        return df.filter(self.where())


@dataclass(frozen=True)
class _Leaf(Filter):
    field: str
    value: Any = None

    def __post_init__(self) -> None:
        """Where a kind of condition checks its value."""

    def test(self, c: Column) -> Column:
        raise NotImplementedError

    def column(self) -> Column:
        return F.coalesce(self.where(), F.lit(False))

    def where(self) -> Column:
        return self.test(F.col(self.field))


class Eq(_Leaf):
    def test(self, c):
        return c == self.value


class Has(_Leaf):
    """A member of a list."""

    def test(self, c):
        return F.array_contains(c, self.value)


class Ne(_Leaf):
    def where(self):
        return ~Eq(self.field, self.value).column()


class _Number(_Leaf):
    """A comparison with a number; any other value is an error."""

    def __post_init__(self):
        from .collection import EngineError

        if isinstance(self.value, bool) or not isinstance(self.value, (int, float)):
            raise EngineError(EngineError.INVALID, f"{self.field} is compared with {self.value!r}, which is no number")


class Lt(_Number):
    def test(self, c):
        return c < self.value


class Le(_Number):
    def test(self, c):
        return c <= self.value


class Gt(_Number):
    def test(self, c):
        return c > self.value


class Ge(_Number):
    def test(self, c):
        return c >= self.value


class Prefix(_Leaf):
    def test(self, c):
        return c.startswith(self.value)


class Contains(_Leaf):
    def test(self, c):
        return c.contains(self.value)


class Between(_Leaf):
    """(low, high), both inclusive; strings compare by code point."""

    def test(self, c):
        return c.between(*self.value)


class TextLess(_Leaf):
    """Before the value in the order of strings, whatever the field's type: "10" is before "9"."""

    def test(self, c):
        return c.cast("string") < str(self.value)


class TextGreater(_Leaf):
    """After the value in the order of strings."""

    def test(self, c):
        return c.cast("string") > str(self.value)


class HasAll(_Leaf):
    """All members of a list."""

    def test(self, c):
        return reduce(lambda a, b: a & b, (F.array_contains(c, v) for v in self.value), c.isNotNull())


class In(_Leaf):
    def test(self, c):
        return c.isin(*self.value) if self.value else F.lit(False)


class Exists(_Leaf):
    def test(self, c):
        return c.isNotNull()


class _Many(Filter):
    def __init__(self, *parts: Filter):
        self.parts = parts


class And(_Many):
    def column(self):
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))

    def where(self):
        return reduce(lambda a, b: a & b, (p.where() for p in self.parts), F.lit(True))


class Or(_Many):
    def column(self):
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))

    def where(self):
        return reduce(lambda a, b: a | b, (p.where() for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self):
        return ~self.part.column()


def count_matching(df: DataFrame, where: Filter) -> DataFrame:
    return where.of(df).agg(F.count("*").alias("n"))


def by_values(df: DataFrame, wanted: dict[str, tuple[str, list]]) -> DataFrame:
    """Rows that meet each field's ("any" or "not", values)."""
    return And(*[In(f, v) if how == "any" else Not(In(f, v)) for f, (how, v) in wanted.items()]).of(df)


def use_graph(candidates: int, k: int) -> bool:
    """Whether a filtered search should walk a graph (many candidates) or scan."""
    return candidates > 5 * k
