"""Prices, fees, costs and scores of a quoting strategy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Taker fee rates by category.
TAKER_RATES = {
    "crypto": 0.072, "sports": 0.03, "finance": 0.04, "politics": 0.04, "economics": 0.05, "culture": 0.05,
    "weather": 0.05, "other": 0.05, "mentions": 0.04, "tech": 0.04, "geopolitics": 0.0,
}
SLIPPAGE_USD, FINANCING_RATE = 0.02, 0.045


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves upwards, negative ones too: floor(x + 1/2)."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def round_up_fee(contracts: Column, price: Column, maker: Column) -> Column:
    """USD, rounded up to a cent: a coefficient times contracts times price times (1 - price)."""
    rate = F.when(maker, 0.0175).otherwise(0.07)
    return F.ceil(rate * contracts * price * (1 - price) * 100 - 1e-12) / 100


def category_fee(contracts: Column, price: Column, category: Column) -> Column:
    """USD to five digits, 0 below 0.00001; null for an unknown category."""
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in TAKER_RATES.items() for x in kv)), category)
    fee = half_up(contracts * rate * price * (1 - price), 5)
    return F.when(fee < 0.00001, 0.0).otherwise(fee)


def side_price(price_yes: Column, side: Column) -> Column:
    return F.when(side == "no", 1 - price_yes).otherwise(price_yes)


def contracts_for(premium: Column, price_yes: Column, side: Column) -> Column:
    return F.when(premium <= 0, 0.0).otherwise(premium / side_price(price_yes, side))


def leg_cost(fee: Column, size: Column, hold_days: Column) -> Column:
    """Fee, one way's slippage and what the money would have earned until resolution."""
    slip = F.when(size > 0, SLIPPAGE_USD).otherwise(0.0)
    return fee + slip + F.when((size > 0) & (hold_days > 0), size * FINANCING_RATE * (hold_days / 365)).otherwise(0.0)


def spread_capture(side: Column, fair: Column, price: Column, size: Column) -> Column:
    """Cents by which a fill was better than the fair value of its side."""
    return (
        F.when(side == "yes_buy", (fair - price) * size).when(side == "yes_sell", (price - fair) * size)
        .when(side == "no_buy", ((100 - fair) - price) * size).when(side == "no_sell", (price - (100 - fair)) * size)
    )


def yes_delta(side: Column, size: Column) -> Column:
    return F.when(side.isin("yes_buy", "no_sell"), size).when(side.isin("yes_sell", "no_buy"), -size)


def blend(mid_a: Column, mid_b: Column, weight_a: Column, weight_b: Column) -> Column:
    """Two mids by their liquidity (1 if unknown); the first where the second is missing."""
    a, b = F.coalesce(weight_a, F.lit(1.0)), F.coalesce(weight_b, F.lit(1.0))
    return F.when(mid_b.isNull(), mid_a).otherwise((mid_a * a + mid_b * b) / F.nullif(a + b, F.lit(0.0)))


def pair_confidence(title: Column, slug: Column, entity: Column, shared_topics: Column, keywords: Column, strength: Column, topic_bonus: Column, time_bonus: Column, embedding: Column) -> Column:
    """Struct of the confidences that two listings are equivalent, or proxies of each other."""
    core = 0.25 * title + 0.20 * slug + 0.25 * entity.cast("int") + 0.30 * F.coalesce(embedding, F.lit(0.0))
    equivalent = F.least(F.lit(1.0), core + F.when(entity, 0.15).otherwise(0.0) + F.when(title > 0.5, 0.1).otherwise(0.0))
    proxy = equivalent * 0.75 + keywords * 0.15 + strength * 0.1 + topic_bonus + time_bonus
    proxy = F.when(shared_topics & ~entity, F.least(F.lit(0.96), proxy + 0.1)).otherwise(proxy)
    return F.struct(half_up(equivalent, 4).alias("equivalent_confidence"), half_up(F.least(F.lit(0.97), proxy), 4).alias("proxy_confidence"))


def edge_weight(same: Column, title: Column, slug: Column, embedding: Column) -> Column:
    return half_up(F.when(same, 0.4).otherwise(0.1) + 0.25 * title + 0.15 * slug + 0.2 * F.coalesce(embedding, F.lit(0.0)), 4)


def attachment(subcategory_a: Column, subcategory_b: Column, days: Column, title_similarity: Column) -> Column:
    """How well a listing fits an event, other than in sports: 0.12 where the subcategories differ."""
    sub = F.when((subcategory_a != "") & (subcategory_b != ""), 1.0).when((subcategory_a != "") | (subcategory_b != ""), 0.88).otherwise(1.0)
    date = F.when(days.isNull(), 0.55).when(days == 0, 1.0).when(days == 1, 0.78).otherwise(F.greatest(F.lit(0.0), 0.5 - days * 0.08))
    return F.when((subcategory_a != "") & (subcategory_b != "") & (subcategory_a != subcategory_b), 0.12).otherwise(0.28 * sub + 0.32 * date + 0.4 * title_similarity)


def mid_and_spread(best_yes: Column, best_no: Column) -> Column:
    """Of the best bids of both sides; nulls where one is missing or the book is crossed."""
    fine = best_yes.isNotNull() & best_no.isNotNull() & (100 - best_no >= best_yes)
    return F.struct(F.when(fine, (best_yes + 100 - best_no) / 2).alias("mid_cents"), F.when(fine, 100 - best_no - best_yes).alias("spread_cents"))
