"""One pass that attaches listings to events and links what two venues list of one event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Least score of an attachment, listings of a pass, sports that are leagues (preferred, and subcategories).
LEAST_SCORE, MOST_LISTINGS = 0.5, 500
LEAGUES = "mlb nba nhl mls epl soccer".split()


@dataclass
class Pass:
    """What a pass writes: attachments (market_id, provider_id, event_id, slot_id, score), slots (slot_id, event_id, template),
    links (slot_id, market_id, provider_id, confidence); and the listings that it left (market_id, reason)."""

    attachments: DataFrame
    slots: DataFrame
    links: DataFrame
    leftovers: DataFrame


def next_listings(markets: DataFrame, mapped: DataFrame, most: int = MOST_LISTINGS) -> DataFrame:
    """The first `most` listings that are attached to nothing: those of which teams and day are known first, then the
    venues in turn, leagues and the latest seen before others."""
    known = F.when(F.col("home").isNotNull() & F.col("away").isNotNull() & F.col("game_day").isNotNull(), 0).otherwise(1)
    league = F.when(F.lower(F.coalesce("sport", F.lit(""))).isin(*LEAGUES), 0).otherwise(1)
    rows = markets.where(F.col("status").isNull() | F.col("status").isin("active", "open")).join(mapped.select("market_id"), "market_id", "left_anti")
    rows = rows.withColumns({"_known": known, "_league": league})
    order = [F.col("_league"), F.desc_nulls_last("last_seen_us"), F.desc("market_id")]
    # No venue's tier gives more than `most`.
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("provider_id", "_known").orderBy(*order))).where(F.col("_turn") <= most)
    return rows.orderBy("_known", "_turn", *order).limit(most).drop("_known", "_league", "_turn")


def best_events(markets: DataFrame, events: DataFrame, score: Callable[[], Column]) -> DataFrame:
    """market_id, event_id, score: of the events of a listing's category within a day of it the one that fits best, the first by
    day and title of those that fit alike. Where events of the listing's league are among them, they alone count.

    score: of the joined columns; the events' are prefixed e_."""
    e = events.select(*(F.col(c).alias(f"e_{c}") for c in events.columns))
    m = markets.where("anchor_day IS NOT NULL AND trim(category) <> ''").withColumn("_day", F.explode(F.sequence(F.col("anchor_day") - 1, F.col("anchor_day") + 1)))
    near = m.join(e, (F.col("category") == F.col("e_category")) & (F.col("_day") == F.col("e_day")))
    league = F.when(F.lower("sport").isin(*LEAGUES), F.lower("sport"))
    near = near.withColumn("_own", F.coalesce(league == F.col("e_subcategory"), F.lit(False)).cast("int")).withColumn("_score", score())
    first = F.struct(F.col("_own").alias("own"), F.col("_score").alias("score"), (-F.col("e_day")).alias("day"))
    # The greatest (own, score), then the least day, title and id.
    rank = Window.partitionBy("market_id").orderBy(F.desc(first), "e_title", "e_event_id")
    return near.withColumn("_n", F.row_number().over(rank)).where("_n = 1").select("market_id", F.col("e_event_id").alias("event_id"), F.col("_score").alias("score"))


def auto_link(
    markets: DataFrame, events: DataFrame, mapped: DataFrame, linked: DataFrame, score: Callable[[], Column], least: float = LEAST_SCORE, most: int = MOST_LISTINGS
) -> Pass:
    """markets: market_id, provider_id (1 or 2), category, sport, status, home, away, game_day, anchor_day, last_seen_us, template;
    events: event_id, category, subcategory, day, title; mapped: market_id, provider_id, event_id, slot_id, template, score, of what is
    attached already; linked: market_id. Written once applied, a second pass over the same rows writes nothing."""
    examined = written(next_listings(markets, mapped, most), "examined")
    best = best_events(examined, events, score)
    judged = written(examined.select("market_id", "provider_id", "template").join(best, "market_id", "left"), "judged")
    slot = F.concat_ws(":", "event_id", F.coalesce("template", F.lit("unknown")))
    attached = judged.where(F.col("score") >= least).withColumn("slot_id", slot)
    leftovers = judged.where(F.col("score").isNull() | (F.col("score") < least))
    slots = attached.select("slot_id", "event_id", F.coalesce("template", F.lit("unknown")).alias("template")).distinct().join(mapped.select("slot_id").distinct(), "slot_id", "left_anti")

    legs = mapped.select("slot_id", "market_id", "provider_id", "score").unionByName(attached.select("slot_id", "market_id", "provider_id", "score"))
    known = linked.select("market_id").distinct().withColumn("_linked", F.lit(1))
    count = lambda venue: F.count_if(F.col("provider_id") == venue)
    pairs = legs.join(known, "market_id", "left").groupBy("slot_id").agg(count(1).alias("one"), count(2).alias("two"), F.max("_linked").alias("held"), F.min("score").alias("confidence"))
    pairs = pairs.where("one = 1 AND two = 1 AND held IS NULL").select("slot_id", "confidence")
    links = legs.select("slot_id", "market_id", "provider_id").join(pairs, "slot_id")
    return Pass(
        attached.select("market_id", "provider_id", "event_id", "slot_id", "score"), slots, links, leftovers.select("market_id", F.when(F.col("score").isNull(), "no_event").otherwise("low_confidence").alias("reason"))
    )
