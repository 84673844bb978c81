"""What an exchange says of orders, fills and markets, in one vocabulary. Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An exchange's words and ours.
ORDER_STATES = {"resting": "open", "canceled": "cancelled", "cancelled": "cancelled", "executed": "filled"}
MARKET_STATES = {"active": "open", "open": "open", "closed": "closed", "settled": "settled"}
SIDES = ("yes_buy", "yes_sell", "no_buy", "no_sell")
# Names under which a fee is told, in dollars; the first that is there counts.
FEE_NAMES = {
    "trade": ("trade_fee_dollars", "trade_fee", "taker_fee_dollars", "taker_fee_cost"),
    "rounding": ("rounding_fee_dollars", "rounding_fee", "rounding_fee_cost"),
    "rebate": ("rebate_dollars", "rebate", "maker_rebate_dollars", "maker_rebate"),
    "net": ("fee_cost", "fees_total_dollars"),
}


def _known(names: dict[str, str], word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), word)


def order_state(word: Column) -> Column:
    return F.coalesce(_known(ORDER_STATES, F.coalesce(word, F.lit(""))), F.lit("open"))


def market_state(word: Column) -> Column:
    """Unknown words stay as they are, in lower case; null for none."""
    low = F.nullif(F.lower(F.trim(word)), F.lit(""))
    return F.coalesce(_known(MARKET_STATES, low), low)


def fill_side(side: Column, action: Column) -> Column:
    name = F.concat_ws("_", side, action)
    return F.when(name.isin(*SIDES), name).otherwise(SIDES[0])


def yes_price_cents(side: Column, yes_dollars: Column, no_dollars: Column) -> Column:
    dollars = F.when(side == "yes", yes_dollars.cast("double")).otherwise(1 - no_dollars.cast("double"))
    return F.floor(dollars * 100 + 0.5).cast("int")


def fees(fill: Column) -> Column:
    """Struct of net, trade, rounding and rebate in cents. Where only the net is told, a taker's is the trade fee, a maker's
    the trade fee or, if negative, the rebate."""

    def cents(kind: str) -> Column:
        return F.coalesce(*(F.get_json_object(fill, f"$.{n}").try_cast("double") * 100 for n in FEE_NAMES[kind]))

    net, trade, rounding, rebate = (cents(k) for k in ("net", "trade", "rounding", "rebate"))
    alone = net.isNotNull() & trade.isNull() & rounding.isNull() & rebate.isNull()
    taker = F.coalesce(F.get_json_object(fill, "$.is_taker") == "true", F.lit(False))
    return F.struct(
        net.alias("net"), F.when(alone & (taker | (net >= 0)), net).otherwise(trade).alias("trade"), rounding.alias("rounding"),
        F.when(alone & ~taker & (net <= 0), F.abs(net)).otherwise(rebate).alias("rebate"),
    )


def parse_prices(text: Column) -> Column:
    """Numbers from a JSON list, or from one written as a string in JSON."""
    plain = F.when(text.startswith('"'), F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "struct<x:string>")["x"]).otherwise(text)
    return F.transform(F.from_json(plain, "array<string>"), lambda x: x.try_cast("double"))


def settlement_cents(outcome: Column) -> Column:
    return F.when(F.lower(outcome) == "yes", 100).when(F.lower(outcome) == "no", 0)
