"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.similarity import similar_sets
from tidemark.plans.domain import domain


@pytest.mark.parametrize("least", [0.0, 0.25, 0.4, 0.5, 0.8, 0.99])
def test_all_pairs(spark, least):
    rnd = random.Random(3)
    draw = lambda: frozenset(f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(0, 9)))
    a, b = list({draw() for _ in range(80)}), list({draw() for _ in range(70)})
    left = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(a)] + [(900, None)], "left_id int, items array<string>")
    right = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(b)] + [(901, None)], "right_id int, items array<string>")
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in similar_sets(left, right, least).collect()}
    want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and len(x & y) / len(x | y) > least}
    assert got == pytest.approx(want)
    assert want or least > 0.98


def test_titles_and_plan(spark):
    sf = "/root/testdata/sf0.001"
    titles = domain(spark, sf, "markets").select(F.concat_ws(" ", "title", "category", "market_ref").alias("t")).distinct()
    grams = {r["t"]: set(r["g"]) for r in titles.select("t", text.trigrams(F.col("t")).alias("g")).collect()}
    found = similar_sets(titles.select(F.col("t").alias("left_id"), text.trigrams(F.col("t")).alias("items")), titles.select(F.col("t").alias("right_id"), text.trigrams(F.col("t")).alias("items")), 0.4)
    got = {(r["left_id"], r["right_id"]) for r in found.collect()}
    assert got == {(a, b) for a, x in grams.items() for b, y in grams.items() if len(x & y) / len(x | y) > 0.4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
