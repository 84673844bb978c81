"""Upserts as (target, source) -> new target; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Rows of both by key. rules: column -> 'new' (the default: the source's value), 'keep' (the target's), 'coalesce'
    (the source's unless null), 'filled' (the source's unless null or empty), 'greatest'. Raises where the source has a key
    twice: which row should win is not said."""
    rules = rules or {}
    t, s = target.alias("t"), source.alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = same if on is None else on & same
    in_source, in_target = F.col("s._in").isNotNull(), F.col("t._in").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c in keys:
            return F.when(in_source, new).otherwise(old)
        by = rules.get(c, "new")
        both = {"new": new, "keep": old, "coalesce": F.coalesce(new, old), "filled": F.coalesce(F.nullif(new, F.lit("")) if by == "filled" else new, old), "greatest": F.greatest(old, new)}[by]
        return F.when(in_source & in_target, both).when(in_source, new).otherwise(old)

    once = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, F.raise_error(F.lit("the source has a key twice")).cast("int")).otherwise(1)
    t, s = target.withColumn("_in", F.lit(1)).alias("t"), source.withColumn("_in", once).alias("s")
    return t.join(s, on, "full_outer").select(*(pick(c).alias(c) for c in target.columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source whose key the target lacks, each key once (the first by its columns)."""
    first = Window.partitionBy(*keys).orderBy(*(c for c in source.columns if c not in keys) or keys)
    fresh = source.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(target.select(*keys).distinct(), keys, "left_anti").select(*source.columns)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
