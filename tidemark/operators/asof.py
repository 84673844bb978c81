"""As-of joins: the nearest row in time within a tolerance, and the last row at or before a time.

Both cut time into buckets, so that neither a hot key's history nor all pairs of a key ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, tolerance: int, to: str = "value") -> DataFrame:
    """Adds `to`: of the rows of right with the same key within `tolerance` of the time the value of the nearest, of
    equally near ones the earlier; null if there is none. Left rows need a column `row_id` that tells them apart."""
    r = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(right_time) / tolerance).alias("_b"))
    around = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(left_time) / tolerance) + i)).alias("_b")
    l = left.select("row_id", F.col(key).alias("_key"), F.col(left_time).alias("_at"), around)  # noqa: E741
    hit = l.join(r, (l["_key"] == r["_k"]) & (l["_b"] == r["_b"]) & (F.abs(l["_at"] - r["_t"]) <= tolerance))
    best = hit.groupBy("row_id").agg(F.min(F.struct(F.abs(F.col("_at") - F.col("_t")).alias("d"), F.col("_t").alias("t"), F.col("_v").alias("v"))).alias("_m"))
    return left.join(best.select("row_id", F.col("_m.v").alias(to)), "row_id", "left")


def asof_last(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, bucket: int, to: str = "value", order: str | None = None) -> DataFrame:
    """Adds `to`: the last non-null value of right with the same key at or before the time; null if there is none.

    Within a bucket of time a window carries values forward; across buckets only the last value of each travels. Equal
    times: rows of right by `order`, the left row after them."""
    names = left.columns
    l = left.select(F.struct(*names).alias("_row"), F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.where(F.col(value).isNotNull()).select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_o"), F.col(value).alias("_v"))
    both = l.unionByName(r).withColumn("_b", F.floor(F.col("_t") / bucket))
    within = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_v", ignorenulls=True).over(within))
    ends = both.groupBy("_k", "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_o", "_v"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.last("_end._v", ignorenulls=True).over(before).alias("_carried"))
    rows = both.where("_side = 1").join(carry, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_b").eqNullSafe(F.col("_b2")), "left")
    return rows.select("_row.*", F.coalesce("_here", "_carried").alias(to))
