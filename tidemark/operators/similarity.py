"""Joins on set similarity, exact, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs whose sets have a Jaccard similarity above `least`.

    left: left_id, items (distinct); right: right_id, items. Items are put in order, rarest first; two sets that similar
    share one of the first n - floor(least * n) items of each, n being a set's size, and neither size is below `least` times the
    other. So pairs meet on few, rare items, and only those that meet are compared. Null and empty sets join nothing.
    Give each different set once: equal sets meet on every item."""
    counts = left.select(F.explode("items").alias("item")).unionByName(right.select(F.explode("items").alias("item"))).groupBy("item").agg(F.count(F.lit(1)).alias("n"))

    def ordered(rows: DataFrame, key: str) -> DataFrame:
        rare = rows.select(key, F.explode("items").alias("item")).join(counts, "item")
        lists = rare.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("_sorted"))
        return lists.select(key, F.transform("_sorted", lambda x: x["item"]).alias("items"), F.size("_sorted").alias("size"))

    a, b = written(ordered(left, "left_id"), "sets"), written(ordered(right, "right_id"), "sets")
    first = lambda rows, key: rows.select(key, F.col("size").alias(f"{key}_size"), F.explode(F.slice("items", F.lit(1), (F.col("size") - F.floor(F.lit(least) * F.col("size"))).cast("int"))).alias("item"))
    met = first(a, "left_id").join(first(b, "right_id"), "item")
    met = met.where((F.col("left_id_size") > least * F.col("right_id_size")) & (F.col("right_id_size") > least * F.col("left_id_size"))).select("left_id", "right_id").distinct()
    pairs = met.join(a.withColumnsRenamed({"items": "_a", "size": "_na"}), "left_id").join(b.withColumnsRenamed({"items": "_b", "size": "_nb"}), "right_id")
    both = F.size(F.array_intersect("_a", "_b"))
    pairs = pairs.withColumn("similarity", both / (F.col("_na") + F.col("_nb") - both))
    return pairs.where(F.col("similarity") > least).select("left_id", "right_id", "similarity")
