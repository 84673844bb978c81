"""What is costly to work out and the same for many rows, worked out once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def told_by(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the other columns of `known`, by keys in which nulls agree with nulls."""
    named = known.withColumnsRenamed({k: f"_known_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_known_{k}" for k in keys))


def once_each(rows: DataFrame, keys: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with the columns that `add` puts to a table of their keys, which `add` sees once for each different value.

    That table is written: what a caller asks of the new columns would else be worked out before the values are different."""
    return told_by(rows, written(add(rows.select(*keys).distinct()), "known"), keys)
