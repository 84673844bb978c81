"""Which pairs of two venues' rows are worth a proposal, found by joins on keys and buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distinct import told_by

#: Rows of one number in a pack, parts of a bucket's left rows, and parts that all pairs are dealt to.
PACK, DEALS, PARTS = 256, 8, 128


def best_in_bucket(left: DataFrame, right: DataFrame, bucket: str, similarity: Column, least: float) -> DataFrame:
    """For each left_id of a bucket the right_id of the greatest similarity, `least` at least; of equal ones the smallest.

    Rows that are alike but for their ids are compared once, and the smallest right_id of such rows stands for all."""
    mine, others = ([c for c in rows.columns if c != key] for rows, key in ((left, "left_id"), (right, "right_id")))
    pairs = left.select(*mine).distinct().join(right.groupBy(*others).agg(F.min("right_id").alias("right_id")), bucket).withColumn("similarity", similarity).where(F.col("similarity") >= least)
    greatest = lambda rows, *by: rows.groupBy(*by).agg(F.max(F.struct("similarity", (-F.col("right_id")).alias("before"))).alias("b")).select(*by, (-F.col("b.before")).alias("right_id"), "b.similarity")
    return greatest(told_by(left, greatest(pairs, *mine), mine), "left_id")


def within_share(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Pairs that agree in `on` and whose positive numbers a (left) and b (right) differ by less than a share of the larger.

    Numbers that near are in the same or in neighbouring buckets of the logarithm, so pairs meet by equality. Rows of one
    number are compared together, PACK of them at most, and the left ones of a bucket are dealt to DEALS, so that a hot bucket's
    pairs are made by many tasks, each of which holds packs alone."""
    width = -math.log(1 - tolerance)
    place = lambda c: F.floor(F.log(F.col(c)) / width).cast("long")

    def packs(rows: DataFrame, number: str, name: str) -> DataFrame:
        rows, rest = rows.where(F.col(number) > 0), [c for c in rows.columns if c not in (*on, number)]
        parts = rows.groupBy(*on, number).agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("_n"))
        dealt = rows.join(parts, [*on, number]).withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_n")))
        return dealt.groupBy(*on, number, "_part").agg(F.collect_list(F.struct(*rest)).alias(name))

    keys = [*on, "_at", "_deal"]
    near = packs(left, a, "_left").withColumn("_deal", F.pmod(F.xxhash64(a, "_part"), F.lit(DEALS))).drop("_part").withColumn("_at", F.explode(F.array(*(place(a) + k for k in (-1, 0, 1)))))
    far = packs(right, b, "_right").drop("_part").withColumn("_at", place(b)).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    pairs = near.repartition(PARTS, *keys).join(far.repartition(PARTS, *keys), keys).where(F.abs(F.col(a) - F.col(b)) / F.greatest(a, b) < tolerance)
    pairs = pairs.withColumn("_x", F.explode("_left")).drop("_left").withColumn("_y", F.explode("_right")).drop("_right")
    of = lambda rows, number, name: [F.col(c) if c == number else F.col(f"{name}.{c}") for c in rows.columns if c not in on]
    return pairs.select(*on, *of(left, a, "_x"), *of(right, b, "_y"))


def first_by_key(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Each left row with the first right row, by `order`, of its key; left rows without one fall out."""
    others = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return left.join(first, key).select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in others))


def capped(pairs: DataFrame, block: str, score: str, tie: list[str], per_block: int, most: int) -> DataFrame:
    """The first per_block pairs of each block by score, of those the first `most`. Ties go by `tie`."""
    order = [F.desc(score), *tie]
    kept = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy(*order))).where(F.col("_n") <= per_block).drop("_n")
    return kept.orderBy(*order).limit(most)
