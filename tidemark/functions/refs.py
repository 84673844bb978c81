"""What listings' references and metadata say, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor, ceiling, base and slope of the confidence that a title similarity gives, by topic.
TITLE_CONFIDENCE = {"crypto": (0.5, 0.85, 0.42, 0.55), "economics": (0.45, 0.92, 0.4, 0.55)}
LEAST_TITLE_SIMILARITY = 0.14
#: Microseconds of an hour and a day, and the grains that callers may ask for.
UNITS = {"h": 3_600_000_000, "d": 86_400_000_000}
INTERVALS = {"1h": "hour", "1d": "day"}


def event_of(ref: Column) -> Column:
    """A ticker without its last part after a hyphen; whole if it has none."""
    return F.regexp_replace(ref, "-[^-]*$", "")


def slug_of(ref: Column) -> Column:
    """What stands before the first #."""
    return F.substring_index(ref, "#", 1)


def outcome_of(ref: Column) -> Column:
    """What stands after the first #; null without one."""
    return F.when(F.contains(ref, F.lit("#")), F.regexp_replace(ref, "^[^#]*#", ""))


def is_binary_slot(ref: Column) -> Column:
    """Whether a reference names the yes or no of a question."""
    return ref.rlike("^[^#]*#(Yes|No)$")


def anchor_day(game_day: Column, close_us: Column) -> Column:
    """The day of the game, else that on which the listing closes (days since the epoch)."""
    return F.coalesce(game_day, F.floor(close_us / UNITS["d"]).cast("int"))


def title_confidence(similarity: Column, topic: str) -> Column:
    """The confidence of a title similarity; null below the least one."""
    low, high, base, slope = TITLE_CONFIDENCE[topic]
    return F.when(similarity >= LEAST_TITLE_SIMILARITY, F.least(F.greatest(base + slope * similarity, F.lit(low)), F.lit(high)))


def usable_price(*choices: Column) -> Column:
    """The first price above 0 and below 1."""
    return F.coalesce(*(F.when((p > 0) & (p < 1), p) for p in choices))


def strikes_agree(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two strikes differ by less than a share of the larger."""
    return F.abs(a - b) / F.greatest(a, b) < tolerance


def since_us(text: str | None, now_us: int) -> int | None:
    """`12h` and `7d` count back from now, an ISO time stands for itself, nothing for no bound; all else is refused."""
    if not text:
        return None
    if found := re.match(r"(\d+)([hd])\Z", text):
        return now_us - int(found[1]) * UNITS[found[2]]
    from datetime import UTC, datetime

    at = datetime.fromisoformat(text)  # raises ValueError
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)


def interval(text: str) -> str:
    if text not in INTERVALS:
        raise ValueError(f"an interval is one of {sorted(INTERVALS)}, not {text!r}")
    return INTERVALS[text]


def page(limit: int, offset: int, most: int) -> tuple[int, int]:
    """A page's limit, at most `most`, and offset."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and begins at 0 or later")
    return min(limit, most), offset


def _given(*choices: Column) -> Column:
    """The first that is neither null nor blank, without outer spaces."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def series_of(meta: Column, ref: Column) -> Column:
    """A listing's series: as its metadata (JSON text) names it, else its ticker up to the first hyphen; empty without either."""
    r = F.trim(F.coalesce(ref, F.lit("")))
    told = _given(F.get_json_object(meta, "$.series_ticker"), F.get_json_object(meta, "$.seriesTicker"))
    return F.coalesce(told, F.when(F.instr(r, "-") > 1, F.substring_index(r, "-", 1)).otherwise(r))


def game_of(meta: Column, ref: Column) -> Column:
    """What a listing's ticker says of its event: two parts where the first names a GAME, three of four or more, itself of
    one or three, the series of two. Without a ticker what the metadata names."""
    r = F.trim(F.coalesce(ref, F.lit("")))
    parts = F.filter(F.split(r, "-"), lambda p: p != "")
    n, first = F.size(parts), lambda k: F.array_join(F.slice(parts, 1, k), "-")
    by_ticker = (
        F.when(n <= 1, r).when(F.contains(F.upper(F.get(parts, 0)), F.lit("GAME")) & (n >= 3), first(2)).when(n >= 4, first(3)).when(n == 3, r).otherwise(series_of(meta, ref))
    )
    told = _given(F.get_json_object(meta, "$.event_ticker"), F.get_json_object(meta, "$.eventTicker"))
    return F.when(r != "", by_ticker).otherwise(F.coalesce(told, series_of(meta, ref)))


def yes_token(meta: Column) -> Column:
    """The first token id of a listing's metadata (JSON text), which holds an array or the text of one."""
    raw = F.coalesce(*(F.get_json_object(meta, f"$.{k}") for k in ("clob_token_ids", "clobTokenIds", "clob_tokens")))
    first = F.get(F.from_json(raw, "array<string>"), 0)
    return F.when(raw.startswith("["), first)


def swept_prices(prices: Column, bid: Column, ask: Column) -> Column:
    """(yes, bid, ask) of a payload: the first of the prices (JSON text), else the mid; each null outside 0 to 1."""
    within = lambda p: F.when((p >= 0) & (p <= 1), p)
    b, a = bid.try_cast("double"), ask.try_cast("double")
    yes = F.get(F.from_json(prices, "array<string>"), 0).try_cast("double")
    return F.struct(F.coalesce(within(yes), within((b + a) / 2)).alias("yes"), within(b).alias("bid"), within(a).alias("ask"))
