"""Decisions on listings and quotes, row by row: the function library over the domain tables, with SQL written for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listings, quoting
from .domain import domain


def rotation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain(spark, sf_dir, "markets")
    kind = F.when(F.col("sport").isNull(), "finance").when(F.col("sport") == "unknown", "climate").when(F.col("sport") == "nfl", "weather").otherwise("sports")
    hours, ask = (F.col("market_id") % 400).cast("double"), 0.40 + (F.col("size") % 25) / 100.0
    return m.select("market_id", F.round(quoting.rotation_score(F.col("volume"), kind, hours, F.lit(0.40), ask), 4).alias("score"), quoting.position_limit(F.col("size")).cast("int").alias("hard_limit"))


ROTATION_SCORES = """SELECT market_id, round(volume * CASE WHEN sport IS NULL THEN 0 WHEN sport = 'unknown' THEN 0.5 WHEN sport = 'nfl' THEN 0.4 ELSE 1 END
* CASE WHEN market_id % 400 <= 4 THEN 1.5 WHEN market_id % 400 <= 24 THEN 1.2 WHEN market_id % 400 <= 72 THEN 1 WHEN market_id % 400 <= 336 THEN 0.7 ELSE 0.3 END
* CASE WHEN size % 25 <= 1 THEN 0 WHEN size % 25 <= 8 THEN 1 WHEN size % 25 <= 15 THEN 0.8 ELSE 0.4 END, 4) AS score,
CAST(CASE WHEN size > 0 THEN least(greatest(floor(3000 / size), 5), 60) ELSE 5 END AS INTEGER) AS hard_limit FROM markets"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain(spark, sf_dir, "mm_orders")
    net = (F.col("order_id") % 21 - 10).cast("double")
    q = quoting.quote(F.col("price_cents").cast("double"), net, F.lit(3.0), F.lit(8.0), F.col("size"), F.lit(2.0), F.lit(6.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(500.0))
    return o.select("order_id", q.alias("q")).select("order_id", "q.bid", "q.ask", "q.bid_size", "q.ask_size", "q.skew")


QUOTES = """WITH x AS (SELECT order_id, price_cents AS f, order_id % 21 - 10 AS net, floor(size) AS base FROM mm_orders),
s AS (SELECT *, CAST(-sign(net) * floor(6 * least(1, greatest(0, (abs(net) - 3) / 5.0)) + 0.5) AS INTEGER) AS skew FROM x),
p AS (SELECT *, least(greatest(least(greatest(f - 2 + skew, 1), 98), f - 2), f + 2) AS b, least(greatest(least(greatest(f + 2 + skew, 3), 99), f - 2), f + 2) AS a0 FROM s),
r AS (SELECT *, CASE WHEN a0 <= b THEN least(b + 2, 99) ELSE a0 END AS a, greatest(1, floor(base / 2)) AS half FROM p)
SELECT order_id, CAST(b AS INTEGER) AS bid, CAST(a AS INTEGER) AS ask,
CAST(greatest(0, least(CASE WHEN net >= 8 THEN 0 WHEN abs(net) >= 3 AND abs(net) < 8 THEN half ELSE base END, floor(500 / b))) AS INTEGER) AS bid_size,
CAST(greatest(0, least(CASE WHEN -net >= 8 THEN 0 WHEN abs(net) >= 3 AND abs(net) < 8 THEN half ELSE base END, floor(500 / a))) AS INTEGER) AS ask_size, skew FROM r"""


def risk_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain(spark, sf_dir, "mm_orders")
    k = F.col("order_id")
    gate = quoting.failed_gate(
        k % 50 == 0, k % 41 != 0, (k % 17 - 8).cast("double"), F.lit(7.0), -(k % 130), F.lit(120), F.when(k % 37 != 0, k % 700), F.lit(600), F.col("price_cents") * F.col("size"), k % 3000, F.lit(2900),
        F.col("fair_at_place"), (k % 520).cast("double"), F.lit(500.0),
    )
    return o.select("order_id", gate.alias("failed_gate"))


RISK_GATES = """SELECT order_id, CASE WHEN order_id % 50 = 0 THEN 'kill_switch' WHEN order_id % 41 = 0 THEN 'market_disabled' WHEN abs(order_id % 17 - 8) > 7 THEN 'position_hard' WHEN order_id % 130 >= 120 THEN 'daily_loss'
WHEN order_id % 37 = 0 OR order_id % 700 > 600 THEN 'stale_snapshot' WHEN price_cents * size > 2900 OR order_id % 3000 > 2900 THEN 'notional_cap' WHEN fair_at_place IS NULL OR fair_at_place < 1 OR fair_at_place > 99 THEN 'fair_value_range'
WHEN order_id % 520 >= 500 THEN 'toxicity_score' END AS failed_gate FROM mm_orders"""


def pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain(spark, sf_dir, "markets").select("market_id", "sport", "game_day", "event_ref")
    p = domain(spark, sf_dir, "proposals").select("proposal_id", "market_a", "market_b")
    p = p.join(m.toDF("market_a", "sa", "da", "ea"), "market_a").join(m.toDF("market_b", "sb", "db", "eb"), "market_b")
    key = lambda c: F.when(F.length(c) > 3, F.substring(c, 3, 1)).otherwise("unknown")
    fault = listings.sports_pair_fault(F.col("sa"), F.coalesce("sb", "sa"), F.abs(F.col("da") - F.col("db")), key(F.col("ea")), key(F.col("eb")))
    return p.select("proposal_id", fault.alias("fault"))


PAIR_FAULTS = """WITH x AS (SELECT p.proposal_id, a.sport AS sa, coalesce(b.sport, a.sport) AS sb, abs(a.game_day - b.game_day) AS days, CASE WHEN length(a.event_ref) > 3 THEN substr(a.event_ref, 3, 1) ELSE 'unknown' END AS ka,
CASE WHEN length(b.event_ref) > 3 THEN substr(b.event_ref, 3, 1) ELSE 'unknown' END AS kb FROM proposals p JOIN markets a ON a.market_id = p.market_a JOIN markets b ON b.market_id = p.market_b)
SELECT proposal_id, CASE WHEN sa IS NULL OR sb IS NULL OR sa = 'unknown' OR sb = 'unknown' THEN 'sport_unknown' WHEN sa <> sb THEN 'sport_mismatch' WHEN days > 1 THEN 'game_date_delta_gt_1' WHEN ka = 'unknown' OR kb = 'unknown' THEN 'missing_matchup' WHEN ka <> kb THEN 'matchup_mismatch' END AS fault FROM x"""

QUERIES = {
    "rotation_scores": (rotation_scores, ROTATION_SCORES),
    "quotes": (quotes, QUOTES),
    "risk_gates": (risk_gates, RISK_GATES),
    "pair_faults": (pair_faults, PAIR_FAULTS),
}
