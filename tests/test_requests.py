"""Pages and filters that callers choose, candidate joins and reference functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import refs
from tidemark.operators import candidates
from tidemark.operators.folds import ordered_fold, positions
from tidemark.operators.matching import best_matching
from tidemark.plans import requests
from tidemark.plans.domain import domain
from tidemark.streaming import book

SF = "/root/testdata/sf0.001"


def test_since():
    assert refs.since_us(None, 5) is None
    assert refs.since_us("2h", 10 * refs.UNITS["h"]) == 8 * refs.UNITS["h"]
    assert refs.since_us("1970-01-02T00:00:00", 0) == refs.UNITS["d"]
    assert refs.since_us("1970-01-01T01:00:00+01:00", 0) == 0
    for bad in ("3w", "-1d", "soon"):
        with pytest.raises(ValueError):
            refs.since_us(bad, 0)
    assert refs.interval("1h") == "hour"
    with pytest.raises(ValueError):
        refs.interval("1w")
    assert refs.page(1000, 3, 200) == (200, 3)
    with pytest.raises(ValueError):
        refs.page(0, 0, 200)


def test_pages_are_slices_of_one_order(spark):
    every = [r.link_id for r in requests.links_page(spark, SF, limit=200).collect()]
    assert [r.link_id for r in requests.links_page(spark, SF, limit=30, offset=40).collect()] == every[40:70]
    some = requests.links_page(spark, SF, status="inactive", category="Brand#11").collect()
    assert all(r.status == "inactive" and r.category == "Brand#11" for r in some)


def test_a_sport_that_nothing_is_of_gives_all(spark):
    every = requests.open_markets(spark, SF).count()
    assert requests.open_markets(spark, SF, sport="curling").count() == every > requests.open_markets(spark, SF, sport="nfl").count() > 0


@pytest.mark.parametrize(
    ("f", "ref", "expected"),
    [(refs.event_of, "A-B-C", "A-B"), (refs.event_of, "AB", "AB"), (refs.slug_of, "x#y#z", "x"), (refs.outcome_of, "x#y#z", "y#z"), (refs.outcome_of, "x", None), (refs.is_binary_slot, "x#Yes", True), (refs.is_binary_slot, "x#y#Yes", False)],
)
def test_refs(spark, f, ref, expected):
    assert spark.range(1).select(f(F.lit(ref))).first()[0] == expected


def test_prices_and_confidences(spark):
    one = spark.range(1)
    assert one.select(refs.usable_price(F.lit(0.0), F.lit(1.0), F.lit(0.3))).first()[0] == 0.3
    got = one.select(*(F.round(refs.title_confidence(F.lit(s), "economics"), 4) for s in (0.1, 0.14, 0.5, 1.0))).first()
    assert tuple(got) == (None, 0.477, 0.675, 0.92)


def test_within_share_against_all_pairs(spark):
    rnd = random.Random(3)
    a, b = ([(i, rnd.randrange(2), rnd.choice([1.0, 100.0, 1e6]) * (1 + rnd.random() / 20)) for i in range(120)] for _ in range(2))
    got = candidates.within_share(spark.createDataFrame(a, "left_id int, k int, a double"), spark.createDataFrame(b, "right_id int, k int, b double"), ["k"], "a", "b", 0.01).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == sorted((i, j) for i, k, x in a for j, m, y in b if k == m and abs(x - y) / max(x, y) < 0.01)


@pytest.mark.parametrize("seed", range(30))
def test_matching_against_all_choices(seed):
    rnd = random.Random(seed)
    edges = [(a, b, round(rnd.random(), 3)) for a in range(rnd.randint(1, 5)) for b in range(10, 10 + rnd.randint(1, 6)) if rnd.random() < 0.7]

    def best(lefts, used):
        if not lefts:
            return 0.0
        return max([best(lefts[1:], used), *(w + best(lefts[1:], used | {b}) for a, b, w in edges if a == lefts[0] and b not in used)])

    found = best_matching(edges)
    assert sum(w for *_, w in found) == pytest.approx(best(sorted({a for a, *_ in edges}), frozenset()))
    assert all((a, b, w) in edges for a, b, w in found)


def test_folds_keep_null_keys_and_large_ones(spark):
    big = 2**60 + 1
    rows = [(None, 1, 1.0), (None, 2, 1.0), (big, 1, 5.0), (big, 2, None), (big - 1, 1, 7.0)]
    df = spark.createDataFrame(rows, "k long, at long, x double").repartition(1)
    got = ordered_fold(df, "k", ["at"], lambda: {"n": 0, "sum": 0.0}, lambda s, r: {"n": s["n"] + 1, "sum": s["sum"] + (r["x"] or 0)}, "n int, sum double").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, 1, 1.0), (None, 2, 2, 2.0), (big, 1, 1, 5.0), (big, 2, 2, 5.0), (big - 1, 1, 1, 7.0)], key=str)
    fills = spark.createDataFrame([("m", 1, 1, 2.0, 40.0), ("m", 2, 2, None, 50.0), ("m", 3, 3, -2.0, 45.0)], "market_id string, observed_us long, fill_id long, delta double, price double")
    assert [(r.net, r.realized) for r in positions(fills).orderBy("fill_id").collect()] == [(2.0, 0.0), (2.0, 0.0), (0.0, 10.0)]


def test_long_forks(spark):
    headers = spark.range(1, 5001).selectExpr("id AS number", "concat('h', id) AS hash", "concat('h', id - 1) AS parent")
    fork = spark.range(4001, 5003).selectExpr("id AS number", "concat('n', id) AS hash", "CASE WHEN id = 4001 THEN 'h4000' ELSE concat('n', id - 1) END AS parent")
    dropped = book.dropped_blocks(spark, headers.unionByName(fork), "h5000", "n5002")
    assert {r.number for r in dropped.collect()} == set(range(4001, 5001))
    assert book.dropped_blocks(spark, headers, "h5000", "h5000").count() == 0


def test_alike_rows_are_compared_once(spark):
    """800 by 800 rows of few texts: the best of each, though no more than the different texts' pairs are looked at."""
    seen = spark.sparkContext.accumulator(0)

    def similar(x, y):
        seen.add(1)
        return 1.0 if x == y else 0.5

    left = spark.createDataFrame([(i, "k", f"t{i % 4}") for i in range(800)], "left_id long, bucket string, a string")
    right = spark.createDataFrame([(1000 + i, "k", f"t{i % 5}") for i in range(1, 800)], "right_id long, bucket string, b string")
    got = candidates.best_in_bucket(left, right, "bucket", F.udf(similar, "double")(F.col("a"), F.col("b")), 0.9).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(i, 1005 if i % 4 == 0 else 1000 + i % 4) for i in range(800)]
    assert seen.value <= 2 * 4 * 5


def test_hot_number_is_dealt_out(spark):
    """One number in every row: all pairs, whose packs no task holds the most of."""
    left = spark.createDataFrame([(i, "k", 5.0) for i in range(1500)], "left_id long, k string, a double")
    right = spark.createDataFrame([(i, "k", 5.0) for i in range(300)], "right_id long, k string, b double")
    tasks = candidates.within_share(left, right, ["k"], "a", "b", 0.01).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1500 * 300
    assert max(r["count"] for r in tasks) < 0.8 * 1500 * 300


def test_strikes_of_all_listings_are_compared(spark):
    """Listings of odd sizes are no others: of every event's two venues all pairs of near strikes."""
    m = [(r.market_id, r.provider_id, r.event_ref, r.volume) for r in domain(spark, SF, "markets").collect()]
    want = {(a, b) for a, v, e, x in m for b, w, f, y in m if v == 1 and w == 2 and e == f and abs(x - y) / max(x, y) < 0.01}
    got = [tuple(r) for r in requests.strike_pairs(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
