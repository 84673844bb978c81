"""Names, assets, dates and strikes in titles, one case after the other."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import instruments as i

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "raw", "generic"), [("person f", "", True), ("party", "", True), ("x", "", True), (None, "", True), ("individual ab", "", True), ("jane", "Person B", True), ("jane roe", "Jane Roe", False), ("party people", None, False)])
def test_generic(spark, name, raw, generic):
    assert value(spark, i.is_generic_name(L(name).cast("string"), L(raw).cast("string"))) is generic


def test_assets(spark):
    assert [value(spark, i.asset(L(t))) for t in ("Bitcoin up", "ETH or BTC", "solana", "solar", None)] == ["btc", "btc", "sol", None, None]
    assert value(spark, i.asset_fault(L("btc"), L("eth"))) == "crypto_asset_mismatch:btc:eth"
    assert value(spark, i.asset_fault(L("gold"), L("eth"))) == "crypto_asset_mismatch:?:eth"
    assert value(spark, i.asset_fault(L("btc"), L("Bitcoin"))) is None


@pytest.mark.parametrize(
    ("text", "date"), [("on 2026-03-04 or 1/2/2027", "2026-03-04"), ("by 3/7/2026", "2026-03-07"), ("Sept. 9th, 2026", "2026-09-09"), ("before December 31, 2025?", "2025-12-31"), ("in 2026", None), ("", None)]
)
def test_dates(spark, text, date):
    assert value(spark, i.date_in(L(text))) == date


@pytest.mark.parametrize(("text", "strike"), [("above $95K", 95_000.0), ("Bitcoin hit $120,000.50", 120_000.5), ("ETH below $4.5", 4500.0), ("costs $20", 20.0), ("no figure", None)])
def test_strikes(spark, text, strike):
    assert value(spark, i.strike_in(L(text))) == strike


@pytest.mark.parametrize(("net", "cost", "delta", "price", "pnl"), [(2.0, 40.0, -1.0, 45.0, 5.0), (2.0, 40.0, -5.0, 30.0, -10.0), (-2.0, 40.0, 1.0, 45.0, -5.0), (2.0, 40.0, 1.0, 45.0, None), (0.0, None, 1.0, 45.0, None)])
def test_closing(spark, net, cost, delta, price, pnl):
    assert value(spark, i.closing_pnl(*(L(x).cast("double") for x in (net, cost, delta, price)))) == pnl
