"""Ordered rules as data: the first pattern that is found in a text decides."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Iterable[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for pattern, name in reversed(tuple(rules)):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def band(x: Column, bands: Iterable[tuple[float, float]], otherwise: float) -> Column:
    """The value of the first (most, value) whose `most` is not below x."""
    out = F.lit(otherwise)
    for most, value in reversed(tuple(bands)):
        out = F.when(x <= most, value).otherwise(out)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once and stands in the plan once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)
