"""Which listings to quote, at which prices and sizes, and when not to. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import band, first_match

# A category's worth, and that of hours to the close and of a spread in cents (up to each bound).
CATEGORY_WORTH = {
    "sports": 1.0, "crypto": 1.0, "politics": 0.6, "economics": 0.0, "finance": 0.0, "finance/macro": 0.0, "climate": 0.5, "culture": 0.7, "mentions": 0.5,
}
OTHER_WORTH = 0.4
URGENCY = ((4, 1.5), (24, 1.2), (72, 1.0), (336, 0.7))
LATE = 0.3
SPREADS = ((1, 0.0), (8, 1.0), (15, 0.8))
WIDE = 0.4
# Categories by ticker, then by the venue's own category.
TICKERS = (
    (r"\bMIDTERM\b|CONTROLS-|GOVPARTY|^GOV[A-Z]", "politics"), (r"KX.*CPI|CPIMAX|UNEMP", "economics"), (r"\bWTI\b|KXWTI|\bOIL\b", "finance"),
    (r"KXNBA|\bNBA\b|KXMLB|\bMLB\b|KXNHL|\bNHL\b|KXUFC|\bUFC\b|KXPGA|\bPGA\b|KXATP|\bATP\b|KXIPL|\bIPL\b|KXNFL|\bNFL\b", "sports"), (r"KXBTC|KXETH|\bBTC\b|\bETH\b", "crypto"),
)
NAMED = (
    ("sport", "sports"), ("crypto", "crypto"), ("politic", "politics"), ("econ|inflation|employ", "economics"), ("financial|macro", "finance/macro"),
    ("climate", "climate"), ("culture|entertain", "culture"), ("mention", "mentions"),
)
LEAGUES = (
    (r"KXNBA|\bNBA\b", "sports:nba"), (r"KXMLB|\bMLB\b", "sports:mlb"), (r"KXNHL|\bNHL\b", "sports:nhl"), (r"KXNFL|\bNFL\b", "sports:nfl"), (r"KXUFC|\bUFC\b", "sports:mma"),
    (r"KXPGA|\bPGA\b", "sports:golf"), (r"KXATP|\bATP\b", "sports:tennis"), (r"KXIPL|\bIPL\b", "sports:cricket"),
)
GAME = r"^KX[A-Z]+(?:GAME|TOTAL|SPREAD|HIT|HR|GOAL|RUNS)-(\d{2}[A-Z]{3}\d{2}\d{4})"


def category(ticker: Column, event: Column, named: Column) -> Column:
    return F.coalesce(first_match(F.concat_ws(" ", ticker, event), TICKERS), first_match(named, NAMED), F.lit("DEFAULT"))


def sport_key(ticker: Column, event: Column, named: Column) -> Column:
    kind = category(ticker, event, named)
    return F.when(kind == "sports", first_match(F.concat_ws(" ", ticker, event), LEAGUES, "sports:other")).otherwise(kind)


def game_start(ticker: Column) -> Column:
    """The start (UTC) that a game's ticker holds; null if it holds none."""
    return F.try_to_timestamp(F.initcap(F.lower(F.nullif(F.regexp_extract(ticker, GAME, 1), F.lit("")))), F.lit("yyMMMddHHmm"))


def rotation_score(volume: Column, kind: Column, hours: Column, bid: Column, ask: Column) -> Column:
    """Volume times the worth of the category, of the hours to the close and of the spread (prices in dollars)."""
    worth = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_WORTH.items() for x in kv)), kind), F.lit(OTHER_WORTH))
    spread = F.when(ask > bid, F.floor((ask - bid) * 100 + 0.5)).otherwise(0)
    return F.coalesce(volume, F.lit(0.0)) * worth * band(F.coalesce(hours, F.lit(0)), URGENCY, LATE) * band(spread, SPREADS, WIDE)


def position_limit(price: Column) -> Column:
    return F.when(price > 0, F.least(F.greatest(F.floor(3000 / price), F.lit(5)), F.lit(60))).otherwise(5)


def inventory_skew(net: Column, soft: Column, hard: Column, most: Column) -> Column:
    """Cents that quotes move against the inventory: none up to soft, all at hard, in proportion between."""
    h = F.greatest(F.lit(1), F.floor(hard))
    s = F.least(F.greatest(F.lit(0), F.floor(soft)), h - 1)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(net) - s) / (h - s)))
    return -F.sign(net) * F.floor(F.greatest(F.lit(0), most) * share + 0.5)


def side_size(net: Column, soft: Column, hard: Column, base: Column, price: Column, most_cents: Column) -> Column:
    """Contracts to offer on a side: none at its hard limit, half beyond soft, what the notional cap leaves. net: signed so
    that the side makes it larger."""
    whole = F.greatest(F.lit(1), F.floor(base))
    size = F.when(net >= hard, 0).when((F.abs(net) >= soft) & (F.abs(net) < hard), F.greatest(F.lit(1), F.floor(whole / 2))).otherwise(whole)
    return F.when(price > 0, F.greatest(F.lit(0), F.least(size, F.floor(most_cents / price)))).otherwise(0)


def quote(fair: Column, net: Column, soft: Column, hard: Column, base: Column, half: Column, most_skew: Column, best_bid: Column, best_ask: Column, most_cents: Column) -> Column:
    """Struct of bid and ask prices (cents) and sizes: around the fair value, moved by the skew, never crossing the book (a
    side that would is null) and within half a spread of the fair value."""
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    f = clamp(F.floor(fair + 0.5), 1, 99)
    skew = inventory_skew(net, soft, hard, most_skew)
    crossed = clamp(f + half + skew, 3, 99) <= clamp(f - half + skew, 1, 98)
    skew = F.when(crossed, 0).otherwise(skew)
    bid = F.least(clamp(f - half + skew, 1, 98), F.coalesce(best_ask - 1, F.lit(98)))
    ask = F.greatest(clamp(f + half + skew, 3, 99), F.coalesce(best_bid + 1, F.lit(3)))
    inside = lambda x: F.least(F.greatest(x, f - half), f + half)
    bid, ask = F.when(bid >= 1, clamp(inside(bid), 1, 98)), F.when(ask <= 99, clamp(inside(ask), 3, 99))
    ask = F.when(ask <= bid, F.least(bid + 2, F.lit(99))).otherwise(ask)
    return F.struct(
        bid.cast("int").alias("bid"), ask.cast("int").alias("ask"), side_size(net, soft, hard, base, bid, most_cents).cast("int").alias("bid_size"),
        side_size(-net, soft, hard, base, ask, most_cents).cast("int").alias("ask_size"), skew.cast("int").alias("skew"),
    )


def failed_gate(kill: Column, enabled: Column, net: Column, hard: Column, day_pnl: Column, loss_limit: Column, age_s: Column, stale_s: Column, bid_cents: Column, ask_cents: Column, most_cents: Column, fair: Column, toxicity: Column, toxic_from: Column) -> Column:
    """The first check that forbids an order; null if none does."""
    return (
        F.when(F.coalesce(kill, F.lit(False)), "kill_switch").when(~F.coalesce(enabled, F.lit(True)), "market_disabled")
        .when(F.abs(net) > F.when(hard <= 0, 1).otherwise(hard), "position_hard").when((loss_limit > 0) & (day_pnl <= -loss_limit), "daily_loss")
        .when(age_s.isNull() | (age_s > stale_s), "stale_snapshot").when((most_cents > 0) & (F.greatest(bid_cents, ask_cents) > most_cents), "notional_cap")
        .when(fair.isNull() | ~fair.between(1, 99), "fair_value_range").when(toxicity >= toxic_from, "toxicity_score")
    )


def kill_reason(toxicity: Column, toxic_from: Column, day_pnl: Column, loss_limit: Column, adverse_run: Column) -> Column:
    return F.when(toxicity > toxic_from, "toxicity").when((loss_limit > 0) & (day_pnl <= -loss_limit), "daily_loss").when(adverse_run, "consecutive_adverse")


# Tickers that are never quoted, hours to the close, since a game's start and to the opening, volume and prices that allow quoting.
COMBOS, BELOW_STRIKES = "KXMVE", r"-B\d"
LEAST_CLOSE_HOURS, GAME_HOURS, MOST_OPEN_HOURS, THIN_VOLUME, LEAST_PRICE, NO_ASK = 4, 4, 12, 100, 0.01, 0.99


def rotation_fault(ticker: Column, blocked: Column, bid: Column, ask: Column, hours_to_close: Column, hours_to_open: Column, volume: Column, hours_since_game: Column, least_close_hours: float = LEAST_CLOSE_HOURS, game_hours: float = GAME_HOURS) -> Column:
    """Why a listing is not quoted; null where it can be. Prices in dollars; hours_since_game: since a game's start, null
    where the ticker holds none. Faults of form ('not_a_candidate') are passed over without a word by those who ask."""
    form = ticker.startswith(COMBOS) | ticker.rlike(BELOW_STRIKES) | bid.isNull() | ask.isNull() | (bid <= LEAST_PRICE) | (ask <= LEAST_PRICE) | (ask <= bid) | (ask >= NO_ASK)
    cents = lambda p: F.floor(p * 100 + 0.5)
    return (
        F.when(F.coalesce(ticker, F.lit("")) == "", "not_a_candidate").when(F.coalesce(blocked, F.lit(False)), "blocklist")
        .when(form | hours_to_close.isNull() | (hours_to_close < least_close_hours), "not_a_candidate")
        .when((cents(ask) - cents(bid) <= 1) & (F.coalesce(volume, F.lit(0)) < THIN_VOLUME), "locked_and_thin")
        .when(hours_to_open > MOST_OPEN_HOURS, "pre_event_dead_air").when(hours_since_game > game_hours, "game_already_ended")
    )
