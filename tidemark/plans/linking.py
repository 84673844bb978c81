"""The pass that attaches and links listings, and settlements kept as history and as they are now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators.autolink import LEAST_SCORE, MOST_LISTINGS, Pass, auto_link
from .domain import domain


def _score() -> Column:
    """How a listing fits an event, with a title similarity told by their numbers."""
    alike = F.when(F.col("market_id") % 5 == F.col("e_event_id") % 5, 1.0).otherwise(0.1)
    sub = F.coalesce("sub", F.lit(""))
    return F.round(money.attachment(F.when(F.col("e_event_id") % 2 == 0, F.col("e_subcategory")).otherwise(""), sub, F.abs(F.col("anchor_day") - F.col("e_day")), alike), 6)


def linking(spark: SparkSession, sf_dir: str) -> Pass:
    """A pass over the listings that no slot has; slots that stand already are named by their event and template too."""
    m = domain(spark, sf_dir, "markets")
    team = lambda k: F.when(F.col("market_id") % 3 > 0, F.concat(F.lit("team "), F.col("market_id") % k))
    kind = F.get(F.array(*map(F.lit, ("politics", "sports", "crypto"))), (F.col("market_id") % 3).cast("int"))
    sub = F.when(F.col("market_id") % 7 == 0, F.concat(F.lit("sub"), F.col("market_id") % 4))
    template = F.concat_ws("-", F.when(F.col("market_id") % 3 == 0, "winner").otherwise("total"), F.floor(F.col("market_id") / 78) % 50)
    markets = m.select("market_id", "provider_id", kind.alias("category"), "sport", "status", team(9).alias("home"), team(7).alias("away"), "game_day", F.coalesce("game_day", F.floor(F.col("close_us") / 86_400_000_000).cast("int")).alias("anchor_day"), "last_seen_us", template.alias("template"), sub.alias("sub"))
    events = domain(spark, sf_dir, "canonical_events").where("event_day IS NOT NULL").select("event_id", F.col("event_category").alias("category"), "subcategory", F.col("event_day").alias("day"), F.col("slug").alias("title"))
    mapped = markets.where("market_id % 5 = 1").select("market_id", "provider_id", (F.col("market_id") % 50).alias("event_id"), F.concat_ws(":", F.col("market_id") % 50, "template").alias("slot_id"), "template", F.lit(0.9).alias("score"))
    linked = domain(spark, sf_dir, "current_links").where("status = 'active' AND market_id % 4 = 0").select("market_id")
    return auto_link(markets, events, mapped, linked, _score)


_PASS = f"""WITH m AS (SELECT market_id, provider_id, CASE market_id % 3 WHEN 0 THEN 'politics' WHEN 1 THEN 'sports' ELSE 'crypto' END AS category, lower(sport) AS sport, coalesce(game_day, CAST(floor(close_us / 86400000000) AS INT)) AS anchor_day, last_seen_us,
  CASE WHEN market_id % 3 > 0 AND game_day IS NOT NULL THEN 0 ELSE 1 END AS known, CASE WHEN sport IN ('mlb', 'nba', 'nhl', 'mls', 'epl', 'soccer') THEN 0 ELSE 1 END AS league, concat(CASE WHEN market_id % 3 = 0 THEN 'winner' ELSE 'total' END, '-', (market_id // 78) % 50) AS template,
  CASE WHEN market_id % 7 = 0 THEN concat('sub', market_id % 4) ELSE '' END AS sub, status FROM markets),
f AS (SELECT market_id, provider_id, market_id % 50 AS event_id, concat(market_id % 50, ':', template) AS slot_id, 0.9::DOUBLE AS score FROM m WHERE market_id % 5 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY provider_id, known ORDER BY league, last_seen_us DESC NULLS LAST, market_id DESC) AS turn FROM m WHERE market_id % 5 <> 1 AND status IN ('active', 'open')),
x AS (SELECT * FROM r ORDER BY known, turn, league, last_seen_us DESC NULLS LAST, market_id DESC LIMIT {MOST_LISTINGS}),
e AS (SELECT event_id, event_category, event_day, slug, CASE WHEN event_id % 2 = 0 THEN subcategory ELSE '' END AS sub, subcategory FROM canonical_events WHERE event_day IS NOT NULL),
c AS (SELECT x.market_id, e.event_id, e.event_day, e.slug, CASE WHEN x.league = 0 AND e.subcategory = x.sport THEN 1 ELSE 0 END AS own,
  round(CASE WHEN x.sub <> '' AND e.sub <> '' AND x.sub <> e.sub THEN 0.12 ELSE 0.28 * CASE WHEN (x.sub = '') <> (e.sub = '') THEN 0.88 ELSE 1.0 END + 0.32 * CASE WHEN x.anchor_day = e.event_day THEN 1.0 ELSE 0.78 END + 0.4 * CASE WHEN x.market_id % 5 = e.event_id % 5 THEN 1.0 ELSE 0.1 END END, 6)::DOUBLE AS score
  FROM x JOIN e ON e.event_category = x.category AND abs(e.event_day - x.anchor_day) <= 1),
b AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY own DESC, score DESC, event_day, slug, event_id) AS n FROM c),
j AS (SELECT x.market_id, x.provider_id, x.template, b.event_id, b.score FROM x LEFT JOIN b ON b.market_id = x.market_id AND b.n = 1),
a AS (SELECT market_id, provider_id, event_id, concat(event_id, ':', template) AS slot_id, score FROM j WHERE score >= {LEAST_SCORE}),
g AS (SELECT slot_id, market_id, provider_id, score FROM f UNION ALL SELECT slot_id, market_id, provider_id, score FROM a),
k AS (SELECT DISTINCT market_id FROM current_links WHERE status = 'active' AND market_id % 4 = 0),
p AS (SELECT g.slot_id, min(g.score) AS confidence FROM g LEFT JOIN k ON k.market_id = g.market_id GROUP BY 1 HAVING count(*) FILTER (WHERE provider_id = 1) = 1 AND count(*) FILTER (WHERE provider_id = 2) = 1 AND count(k.market_id) = 0)
"""
SQL_OF = {
    "attachments": _PASS + "SELECT market_id, provider_id, event_id, slot_id, score FROM a",
    "slots": _PASS + "SELECT DISTINCT slot_id, event_id, split_part(slot_id, ':', 2) AS template FROM a WHERE slot_id NOT IN (SELECT slot_id FROM f)",
    "links": _PASS + "SELECT g.slot_id, g.market_id, g.provider_id, p.confidence FROM g JOIN p ON p.slot_id = g.slot_id",
    "leftovers": _PASS + f"SELECT market_id, CASE WHEN score IS NULL THEN 'no_event' ELSE 'low_confidence' END AS reason FROM j WHERE score IS NULL OR score < {LEAST_SCORE}",
}


def _part(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(linking(spark, sf_dir), name)

    return run


QUERIES = {f"auto_link_{name}": (_part(name), sql) for name, sql in SQL_OF.items()}
