"""What a listing is about: placeholders for names, assets, dates and strikes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listings import bucket
from .rules import first_match

# Assets by the words that name them; months; words beside which a small dollar figure means thousands.
ASSETS = (("btc", r"\b(btc|bitcoin)\b"), ("eth", r"\b(eth|ethereum)\b"), ("sol", r"\b(sol|solana)\b"))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
IN_THOUSANDS = r"(bitcoin|btc|ethereum|eth|solana|sol|hit|above|below|dip)"


def is_generic_name(name: Column, raw: Column) -> Column:
    """Whether a name stands for nobody in particular: too short, one letter, or `person`, `individual`, `party` with at
    most a letter or two after it."""
    n = F.trim(name)
    stands = r"^(?i:person|individual|party)(\s*[A-Za-z]?|\s+\S{1,2})$"
    return F.coalesce(F.length(name) < 2, F.lit(True)) | (F.length(n) < 2) | n.rlike(stands) | F.coalesce(F.trim(raw).rlike(r"^(?i:person|individual|party)\s*[A-Za-z]?$"), F.lit(False))


def asset(text: Column) -> Column:
    """The asset that a text names first in the order of ASSETS; null for none."""
    return first_match(F.lower(F.coalesce(text, F.lit(""))), [(pattern, key) for key, pattern in ASSETS])


def asset_fault(a: Column, b: Column) -> Column:
    """Why two texts cannot be about one asset; null where they can."""
    x, y = asset(a), asset(b)
    told = F.concat(F.lit("crypto_asset_mismatch:"), F.coalesce(x, F.lit("?")), F.lit(":"), F.coalesce(y, F.lit("?")))
    return F.when(x.isNull() | y.isNull() | (x != y), told)


def bucket_fault(a: Column, b: Column) -> Column:
    """Why two sports titles cannot be one market: both kinds are known and differ."""
    x, y = bucket(a), bucket(b)
    return F.when(x != y, F.concat_ws(":", F.lit("market_type_mismatch"), x, y))


def date_in(text: Column) -> Column:
    """The first date in a text as yyyy-mm-dd: written so, else as month/day/year, else with the month's name."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    iso, slash = r"\b(20\d{2})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})/(\d{1,2})/(20\d{2})\b"
    named = r"(?i)\b(" + "|".join(MONTHS) + r")[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(20\d{2})\b"
    two = lambda x: F.lpad(x, 2, "0")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(named, 1))).cast("string")
    forms = [[part(iso, i) for i in (1, 2, 3)], [part(slash, 3), two(part(slash, 1)), two(part(slash, 2))], [part(named, 3), two(month), two(part(named, 2))]]
    return F.coalesce(*(F.when(y.isNotNull(), F.concat_ws("-", y, m, d)) for y, m, d in forms))


def strike_in(text: Column) -> Column:
    """The first dollar figure of a text: times 1000 with a K, or below 1000 beside words of IN_THOUSANDS or an arrow."""
    number = lambda pattern: F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    thousands, plain = number(r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*K\b"), number(r"\$\s*([\d,]+(?:\.\d+)?)\b")
    small = (plain > 0) & (plain < 1000) & text.rlike(f"(?i){IN_THOUSANDS}")
    return F.coalesce(thousands * 1000, F.when(small, plain * 1000).otherwise(plain))


def closing_pnl(net: Column, cost: Column, delta: Column, price: Column) -> Column:
    """Profit for each contract that a trade closes of the position before it; null where it closes none."""
    return F.when(cost.isNotNull() & (net * delta < 0), F.when(net > 0, price - cost).otherwise(cost - price))
