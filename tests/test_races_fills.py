import pytest
from pyspark.sql import functions as F

from tidemark.functions import fills, races


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_race_signatures(spark):
    cases = [
        ("GOVPARTY-OH-2026-REP", None, "governor_oh_2026"), (None, "ohio governor republican 2026", "governor_oh_2026"), ("SENATE-TX-2026", None, "senate_tx_2026"),
        (None, "texas senate race 2026", "senate_tx_2026"), ("HOUSE-TX-33-2026", None, "house_tx33_2026"), (None, "TX-33 House election 2026", "house_tx33_2026"),
        (None, "Texas 33rd district house race 2026", "house_tx33_2026"), (None, "Who will be the Democratic presidential nominee in 2028?", "pres_nominee_us_2028"),
        (None, "Republican presidential nominee 2028", "pres_nominee_us_2028"), ("austin-mayor-2026", None, "mayor_austin_2026"),
        (None, "Federal Reserve rate decision March 2026", None), (None, "Will government impose tariffs on China?", None), ("GOVPARTYOH-26", None, "governor_oh_2026"),
    ]
    df = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(cases)], "i int, ref string, title string")
    got = {r.i: r.s for r in df.select("i", races.race_signature(F.col("ref"), F.col("title")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_topic_keys(spark):
    for key, name in (("gov_oh_2026", "governor_oh_2026"), ("gov_ohio_2026", "governor_oh_2026"), ("gov_new_york_2026_special", "governor_ny_2026_special"), ("tariffs", "tariffs"), ("", "other"), ("gov_nowhere_2026", "gov_nowhere_2026")):
        assert value(spark, races.topic_key(F.lit(key))) == name


@pytest.mark.parametrize(
    ("fill", "expected"),
    [
        ('{"fee_cost":"0.02","is_taker":true}', (2, 2, None, None)),
        ('{"fee_cost":"-0.01"}', (-1, None, None, 1)),
        ('{"fee_cost":0}', (0, 0, None, 0)),
        ('{"trade_fee":"0.03","maker_rebate":0.01,"fees_total_dollars":"0.02"}', (2, 3, None, 1)),
        ("{}", (None, None, None, None)),
    ],
)
def test_fees(spark, fill, expected):
    got = value(spark, fills.fees(F.lit(fill)))
    assert tuple(got) == pytest.approx(expected)


def test_words(spark):
    assert value(spark, fills.order_state(F.lit("executed"))) == "filled" and value(spark, fills.order_state(F.lit("odd"))) == "open"
    assert value(spark, fills.market_state(F.lit(" Active"))) == "open" and value(spark, fills.market_state(F.lit("odd"))) == "odd" and value(spark, fills.market_state(F.lit(""))) is None
    assert value(spark, fills.fill_side(F.lit("no"), F.lit("sell"))) == "no_sell" and value(spark, fills.fill_side(F.lit("x"), F.lit("y"))) == "yes_buy"
    assert value(spark, fills.yes_price_cents(F.lit("no"), F.lit("0"), F.lit("0.37"))) == 63
    assert value(spark, fills.parse_prices(F.lit('"[\\"0.3\\",\\"0.7\\"]"'))) == [0.3, 0.7] and value(spark, fills.parse_prices(F.lit("[0.3,0.7]"))) == [0.3, 0.7]
