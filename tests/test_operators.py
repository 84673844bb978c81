import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import money, text
from tidemark.operators.asof import asof_last, asof_nearest
from tidemark.operators.folds import ema_step, position_step
from tidemark.operators.matching import best_matching, diversified, match_blocks
from tidemark.operators.merge import insert_new, upsert


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("before", "delta", "price", "after"),
    [
        ((0, None, 0), 8, 40, (8, 40, 0)),
        ((8, 40, 0), 2, 60, (10, 44, 0)),
        ((10, 44, 0), -3, 50, (7, 44, 18)),
        ((7, 44, 18), -7, 40, (0, None, -10)),
        ((5, 60, 0), -12, 40, (-7, 40, -100)),
    ],
)
def test_position_step(before, delta, price, after):
    state = position_step(dict(zip(("net", "cost", "realized"), before, strict=True)), {"delta": delta, "price": price})
    assert (state["net"], state["cost"], state["realized"]) == pytest.approx(after) if after[1] is not None else (state["net"], state["cost"]) == (0, None)


def test_ema_starts_at_the_first_reading():
    s = ema_step({"ema": None, "n": 0, "confidence": 0.0, "at": None}, {"x": 40.0, "t_ms": 0})
    assert (s["ema"], s["confidence"]) == (40.0, 0.08)
    assert ema_step(s, {"x": 60.0, "t_ms": 30_000})["ema"] == 50.0


def test_fees_and_costs(spark):
    lit = F.lit
    assert value(spark, money.round_up_fee(lit(200.0), lit(0.5), lit(False))) == pytest.approx(3.5)
    assert value(spark, money.category_fee(lit(100.0), lit(0.5), lit("sports"))) == pytest.approx(0.75)
    assert value(spark, money.contracts_for(lit(100.0), lit(0.5), lit("yes"))) == 200
    assert value(spark, money.side_price(lit(0.52), lit("no"))) == pytest.approx(0.48)
    for side, fair, price, size, cents in (("yes_buy", 50, 48, 2, 4), ("yes_sell", 50, 55, 1, 5), ("no_buy", 55, 50, 3, -15), ("no_sell", 44, 50, 2, -12)):
        assert value(spark, money.spread_capture(lit(side), lit(fair), lit(price), lit(size))) == cents
    assert value(spark, money.blend(lit(48.0), lit(60.0), lit(2.0), lit(1.0))) == 52
    assert value(spark, money.blend(lit(55.0), lit(None).cast("double"), lit(2.0), lit(1.0))) == 55


@pytest.mark.parametrize(
    ("t", "s", "entity", "shared", "k", "es", "tb", "wb", "emb", "expected"),
    [
        (0.8, 0.7, True, True, 0.6, 1.0, 0.1, 0.05, 0.92, (1.0, 0.97)),
        (0.3, 0.1, True, False, 0.4, 0.7, 0.1, 0.0, None, (0.495, 0.6012)),
        (0.5, 0.4, False, True, 0.5, 0.0, 0.1, 0.0, None, (0.205, 0.4288)),
        (0.6, 0.2, False, False, 0.3, 0.0, 0.0, 0.0, 0.85, (0.545, 0.4538)),
    ],
)
def test_pair_confidence(spark, t, s, entity, shared, k, es, tb, wb, emb, expected):
    c = money.pair_confidence(*(F.lit(x) for x in (t, s, entity, shared, k, es, tb, wb)), F.lit(emb).cast("double"))
    assert tuple(value(spark, c)) == pytest.approx(expected, abs=1.01e-4)


def test_text(spark):
    lit = F.lit
    assert value(spark, text.tokens(lit("Will -X- the U.S. win 2026?"))) == ["will", "the", "win", "2026"]
    assert value(spark, F.round(text.trigram_similarity(lit("word"), lit("two words")), 4)) == 0.3636
    assert value(spark, text.jaccard(F.array(), F.array())) == 0
    assert value(spark, text.topic(lit("Federal Reserve chair nominee"))) == "fed_chair"
    assert value(spark, text.topic(lit("nothing"))) == "other"
    assert value(spark, text.parse_vector(lit("[1, 2, x, 3]"))) == [1, 2, 3]
    assert value(spark, text.slug(lit("  Hello, World! "))) == "hello-world"
    assert value(spark, text.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) is None


def test_asof_against_brute_force(spark):
    rnd = random.Random(5)
    left = [(i, rnd.randrange(3), rnd.randrange(1000)) for i in range(200)]
    right = [(rnd.randrange(4), rnd.randrange(1000), rnd.choice([None, *range(50)]), i) for i in range(150)]
    l = spark.createDataFrame(left, "row_id long, k long, t long")  # noqa: E741
    r = spark.createDataFrame(right, "k long, rt long, v long, o long")
    got = {x["row_id"]: x["value"] for x in asof_last(l, r, "k", "t", "rt", "v", 64, order="o").collect()}
    for i, k, t in left:
        seen = [(rt, o, v) for kk, rt, v, o in right if kk == k and rt <= t and v is not None]
        assert got[i] == (max(seen)[2] if seen else None)
    near = {x["row_id"]: x["value"] for x in asof_nearest(l, r.where("v IS NOT NULL"), "k", "t", "rt", "v", 20).collect()}
    for i, k, t in left:
        seen = [(abs(rt - t), rt, v) for kk, rt, v, _ in right if kk == k and v is not None and abs(rt - t) <= 20]
        assert near[i] == (min(seen)[2] if seen else None)


def test_matching_against_all_choices(spark):
    rnd = random.Random(2)
    for _ in range(30):
        edges = [(a, b, rnd.random()) for a in range(4) for b in range(4) if rnd.random() < 0.6]
        best = max((sum(w for w in (next((w for a, b, w in edges if (a, b) == (i, p)), 0) for i, p in enumerate(perm))) for perm in itertools.permutations(range(4))), default=0)
        found = best_matching(edges)
        assert sum(w for *_, w in found) == pytest.approx(best)
        assert len({a for a, *_ in found}) == len({b for _, b, _ in found}) == len(found)
    df = spark.createDataFrame([("x", 1, 10, 0.9), ("x", 1, 11, 0.8), ("x", 2, 10, 0.8), ("y", 3, 12, 0.1)], "block string, left_id long, right_id long, weight double")
    assert {(r.left_id, r.right_id) for r in match_blocks(df).collect()} == {(1, 11), (2, 10), (3, 12)}


def test_diversified_against_the_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(f"t{i:03}", f"e{rnd.randrange(12)}", rnd.choice(["a", "b", "c", None]), float(rnd.randrange(-2, 40))) for i in range(300)]
    got = {r.ticker for r in diversified(spark.createDataFrame(rows, "ticker string, event string, sport string, score double"), 12).collect()}
    events, sports, expected = {}, {}, set()
    for t, e, s, x in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(expected) < 12 and x > 0 and events.get(e, 0) < 3 and sports.get(s, 0) < 5:
            events[e], sports[s] = events.get(e, 0) + 1, sports.get(s, 0) + 1
            expected.add(t)
    assert got == expected


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, name string, n long")
    new = spark.createDataFrame([(2, "", 4), (3, None, 1)], "k long, name string, n long")
    got = {tuple(r) for r in upsert(old, new, ["k"], {"name": "filled", "n": "greatest"}).collect()}
    assert got == {(1, "a", 5), (2, "b", 6), (3, None, 1)}
    assert [tuple(r) for r in insert_new(old, new, ["k"]).collect()] == [(3, None, 1)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "block string, left_id long, right_id long, weight double")
    assert match_blocks(empty).count() == 0
    assert pd.DataFrame(best_matching([])).empty
    assert Row() == Row()


def test_a_repeated_source_key_is_refused(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="key twice"):
        upsert(target, spark.createDataFrame([(2, "b"), (2, "c")], "k int, v string"), ["k"]).collect()
