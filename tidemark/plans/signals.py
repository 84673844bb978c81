"""Signals: executable edges, gap sessions, signal quality and calibration, divergences, and the backtest over them."""

from __future__ import annotations

from .dialect import Dialect, Text

#: A session ends after a longer gap than this; the two reference thresholds are 90 s and 120 s, the test events are sparser.
GAP_US = 1_800_000_000
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def _edges(d: Dialect) -> str:
    return "SELECT id, candidate, event_id, observed_us, bid_1 - ask_2 AS edge FROM spreads WHERE bid_1 IS NOT NULL AND ask_2 IS NOT NULL AND bid_1 > ask_2"


def windows(gap_us: int = GAP_US) -> str:
    """CTEs edges, gaps, sessions, windows: sessions of executable edges with why they are rejected, if they are."""
    return f"""edges AS ({_edges(None)}),
gaps AS (SELECT *, observed_us - lag(observed_us) OVER (PARTITION BY candidate, event_id ORDER BY observed_us, id) AS gap FROM edges),
sessions AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap_us} THEN 1 ELSE 0 END) OVER
  (PARTITION BY candidate, event_id ORDER BY observed_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM gaps),
raw_windows AS (SELECT candidate, event_id, min(observed_us) AS start_us, max(observed_us) AS end_us, CAST(floor((max(observed_us) - min(observed_us)) / 1000000.0 + 0.5) AS BIGINT) AS duration_s,
  count(*) AS observations, max(edge) AS max_edge, avg(edge) AS avg_edge FROM sessions GROUP BY candidate, event_id, grp),
windows AS (SELECT *, CASE WHEN duration_s < 60 THEN 'duration_too_short' WHEN observations < 2 THEN 'too_few_ticks' WHEN avg_edge < 0.001 THEN 'edge_too_small' END AS rejection_reason FROM raw_windows),
quality AS (SELECT candidate, event_id, avg(avg_edge) AS avg_edge, avg(duration_s) AS avg_duration_s, max(end_us) AS last_us,
  CASE WHEN max(end_us) > min(start_us) THEN count(*) / (CAST(max(end_us) - min(start_us) AS DOUBLE) / 3600000000) ELSE CAST(0 AS DOUBLE) END AS per_hour FROM windows WHERE rejection_reason IS NULL GROUP BY candidate, event_id),
scored AS (SELECT *, avg_edge * (1 + ln(1 + least(per_hour, 100.0))) AS score FROM quality),
calibrated AS (SELECT *, percent_rank() OVER (ORDER BY score) AS percentile FROM scored),
stable AS (SELECT w.*, c.percentile, coalesce(c.percentile, 0) * ln(1 + w.duration_s) AS stability FROM windows w LEFT JOIN calibrated c ON w.candidate = c.candidate AND w.event_id = c.event_id)"""


def over(body: str, gap_us: int = GAP_US) -> Text:
    return lambda d: f"WITH {windows(gap_us)} {body}"


_STATS = "count(*) AS total_trades, round(avg(avg_edge), 8) AS mean_edge, round(avg(duration_s), 6) AS mean_duration_s, round(sum(avg_edge), 6) AS total_edge, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY duration_s), 6) AS median_duration_s"

_CONSENSUS = """latest AS (SELECT market_id, observed_us, price_yes, liquidity FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, snapshot_id DESC) AS rn FROM snapshots) AS s WHERE rn = 1),
legs AS (SELECT f.family_id, f.label, f.event_id, l.link_id, p.provider, l.market_id, l.relationship_type, l.status, l.confidence, s.observed_us, s.price_yes, s.liquidity,
  CASE l.relationship_type WHEN 'identical' THEN 0 WHEN 'equivalent' THEN 1 WHEN 'proxy' THEN 2 ELSE 3 END AS type_order,
  CASE WHEN l.status = 'active' AND s.price_yes IS NOT NULL THEN coalesce(s.liquidity, 1) * l.confidence *
    CASE l.relationship_type WHEN 'identical' THEN 1.0 WHEN 'equivalent' THEN 1.0 WHEN 'proxy' THEN 0.5 ELSE 0.25 END END AS weight
  FROM families f JOIN current_links l ON l.family_id = f.family_id JOIN providers p ON p.provider_id = l.provider_id JOIN markets m ON m.market_id = l.market_id LEFT JOIN latest s ON s.market_id = l.market_id),
scored AS (SELECT *, sum(weight * price_yes) OVER (PARTITION BY family_id) / nullif(sum(weight) OVER (PARTITION BY family_id), 0) AS consensus FROM legs),
diverging AS (SELECT *, abs(price_yes - consensus) AS divergence, max(observed_us) OVER (PARTITION BY family_id) AS family_last_us FROM scored),
ranked AS (SELECT *, max(divergence) OVER (PARTITION BY family_id) AS max_divergence FROM diverging)"""

QUERIES: dict[str, Text] = {
    "executable_edges": lambda d: "SELECT id, candidate, bid_1, ask_2, round(bid_1 - ask_2, 6) AS executable_edge, observed_us FROM spreads WHERE bid_1 IS NOT NULL AND ask_2 IS NOT NULL AND bid_1 > ask_2",
    "edge_windows_generation": over("SELECT candidate, event_id, concat(candidate, '|', event_id, '|', start_us) AS window_id, start_us, end_us, duration_s, observations, round(max_edge, 6) AS max_edge, round(avg_edge, 8) AS avg_edge, rejection_reason FROM windows"),
    "edge_windows": over("SELECT candidate, event_id, start_us, end_us, duration_s, observations, round(avg_edge, 8) AS avg_edge FROM windows WHERE rejection_reason IS NULL"),
    "edge_events": over("SELECT candidate, event_id, start_us, end_us, duration_s, round(max_edge, 6) AS max_edge, round(avg_edge, 8) AS avg_edge, observations FROM raw_windows", 2_400_000_000),
    "signal_quality": over("SELECT candidate, event_id, round(score, 6) AS execution_score, round(avg_edge, 8) AS avg_edge, round(avg_duration_s, 6) AS avg_duration_s, round(per_hour, 6) AS events_per_hour, last_us FROM scored"),
    "signal_calibrated": over("SELECT candidate, event_id, round(score, 6) AS execution_score, round(percentile, 6) AS score_percentile, percentile >= 0.90 AS execute_default FROM calibrated"),
    "top_signals": over("SELECT candidate, event_id, round(score, 6) AS execution_score, round(percentile, 6) AS score_percentile, last_us FROM calibrated ORDER BY score DESC, candidate, event_id LIMIT 20"),
    "execution_decision": over("SELECT candidate, event_id, round(percentile, 6) AS score_percentile, percentile >= 0.90 AS execute_default, last_us FROM calibrated WHERE candidate = 'c1' ORDER BY last_us DESC, event_id LIMIT 1"),
    "routing_top": over("SELECT candidate, event_id, round(percentile, 6) AS confidence FROM calibrated WHERE percentile >= 0.8 ORDER BY percentile DESC, candidate, event_id LIMIT 20"),
    "backtest_naive": over(f"SELECT {_STATS} FROM windows WHERE duration_s > 0"),
    "backtest_filtered": over(f"SELECT {_STATS} FROM stable WHERE duration_s > 0 AND percentile >= 0.9"),
    "backtest_sweep": over(f"SELECT CAST(t.threshold AS DOUBLE) AS threshold, m.min_s, {_STATS} FROM stable w CROSS JOIN (VALUES (0.5), (0.55), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) AS t(threshold) CROSS JOIN (VALUES (0), (60), (120), (300)) AS m(min_s) WHERE duration_s > 0 AND duration_s >= m.min_s AND percentile >= t.threshold GROUP BY t.threshold, m.min_s"),
    "backtest_stability": over(f", pairs AS (SELECT candidate, event_id, max(stability) AS best FROM stable GROUP BY candidate, event_id), chosen AS (SELECT candidate, event_id FROM pairs WHERE best > 1) SELECT {_STATS} FROM stable w WHERE duration_s > 0 AND EXISTS (SELECT 1 FROM chosen c WHERE c.candidate = w.candidate AND c.event_id = w.event_id)"),
    "backtest_per_event": over("SELECT event_id, count(*) AS total_trades, round(avg(avg_edge), 8) AS mean_edge, round(avg(duration_s), 6) AS mean_duration_s FROM stable WHERE duration_s > 0 AND percentile >= 0.5 GROUP BY event_id"),
    "backtest_lift": over(", n AS (SELECT avg(avg_edge) AS e, avg(duration_s) AS t, count(*) AS k FROM windows WHERE duration_s > 0), f AS (SELECT avg(avg_edge) AS e, avg(duration_s) AS t, count(*) AS k FROM stable WHERE duration_s > 0 AND percentile >= 0.8) SELECT round(f.e / nullif(n.e, 0), 6) AS edge_lift, round(f.t / nullif(n.t, 0), 6) AS duration_lift, round(100 * CAST(f.k AS DOUBLE) / nullif(n.k, 0), 6) AS pct_of_naive FROM n CROSS JOIN f"),
    "backtest_rejections": over("SELECT event_id, coalesce(rejection_reason, 'accepted') AS rejection_reason, count(*) AS cnt FROM windows GROUP BY 1, 2"),
    "backtest_min_duration": over("SELECT event_id, count(*) AS windows_all, count(*) FILTER (WHERE duration_s >= 60) AS windows_60s, count(*) FILTER (WHERE duration_s >= 120) AS windows_120s, count(*) FILTER (WHERE duration_s >= 300) AS windows_300s FROM windows GROUP BY event_id"),
    "backtest_q1": over("SELECT candidate, count(*) AS total_windows, round(avg(avg_edge), 8) AS mean_edge, round(avg(duration_s), 6) AS mean_duration, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY duration_s), 6) AS median_duration, round(sum(avg_edge), 6) AS total_edge FROM windows WHERE event_id = 'click' GROUP BY candidate"),
    "backtest_q4": over("SELECT event_id, candidate, count(*) AS n FROM windows WHERE event_id IN ('click', 'view', 'purchase') AND duration_s > 0 GROUP BY event_id, candidate HAVING count(*) >= 1"),
    "backtest_debug": over(", meta AS (SELECT candidate, event_id, source_meta FROM (SELECT candidate, event_id, source_meta, row_number() OVER (PARTITION BY candidate, event_id ORDER BY observed_us DESC, id DESC) AS rn FROM spreads) AS x WHERE rn = 1) SELECT w.candidate, w.event_id, w.start_us, w.duration_s, round(w.percentile, 6) AS score_percentile, m.source_meta FROM stable w LEFT JOIN meta m ON m.candidate = w.candidate AND m.event_id = w.event_id"),
    "backtest_stability_rank": over(", s AS (SELECT candidate, event_id, start_us, stability, row_number() OVER (ORDER BY stability DESC, candidate, event_id, start_us) - 1 AS i, count(*) OVER () AS n FROM stable) SELECT candidate, event_id, start_us, round(stability, 6) AS stability, round(CASE WHEN n <= 1 THEN 1.0 ELSE CAST(n - 1 - i AS DOUBLE) / (n - 1) END, 6) AS positional_percentile FROM s WHERE i < 500"),
    "backtest_pair_coverage": over(", cfg AS (SELECT DISTINCT candidate, event_id FROM spreads), seen AS (SELECT candidate, event_id, count(*) AS n_windows, count(*) FILTER (WHERE rejection_reason IS NULL) AS n_valid FROM windows GROUP BY 1, 2) SELECT c.candidate, c.event_id, coalesce(n_windows, 0) AS n_windows, CASE WHEN n_windows IS NULL THEN 'no_windows' WHEN n_valid = 0 THEN 'all_rejected' ELSE 'ok' END AS coverage FROM cfg c LEFT JOIN seen s ON s.candidate = c.candidate AND s.event_id = c.event_id"),
    "top_divergences": lambda d: f"WITH {_CONSENSUS}, top_families AS (SELECT family_id, max(max_divergence) AS m FROM ranked GROUP BY family_id ORDER BY m DESC NULLS LAST, family_id LIMIT 50) SELECT r.family_id, r.label, r.link_id, r.provider, r.market_id, r.relationship_type, round(r.confidence, 4) AS confidence, r.observed_us, r.price_yes, round(r.consensus, 6) AS consensus_price, round(r.divergence, 6) AS divergence, round(r.max_divergence, 6) AS max_divergence, r.family_last_us FROM ranked r JOIN top_families t ON t.family_id = r.family_id",
    "divergence_by_event": lambda d: f"WITH {_CONSENSUS} SELECT event_id, count(*) AS legs, round(avg(divergence), 6) AS mean_divergence, round(max(divergence), 6) AS max_divergence FROM ranked GROUP BY event_id",
    "market_families": lambda d: f"WITH {_CONSENSUS} SELECT family_id, label, count(*) AS n_links, round(max(consensus), 6) AS consensus_price, count(price_yes) AS priced FROM ranked WHERE event_id = 7 GROUP BY family_id, label",
    "politics_insights": lambda d: f"WITH {_CONSENSUS}, f AS (SELECT family_id, count(*) AS legs, round(max(max_divergence), 6) AS max_divergence, max(CASE WHEN provider = 'exch' THEN price_yes END) AS price_1, max(CASE WHEN provider = 'pool' THEN price_yes END) AS price_2 FROM ranked GROUP BY family_id) SELECT * FROM f WHERE legs >= 2 ORDER BY max_divergence DESC NULLS LAST, family_id LIMIT 100",
    "latest_snapshots": lambda d: "SELECT market_id, observed_us, price_yes, liquidity FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, snapshot_id DESC) AS rn FROM snapshots) AS s WHERE rn = 1",
    "snapshot_history": lambda d: f"SELECT p.provider, CAST(floor(s.observed_us / {DAY_US}) AS BIGINT) AS day, floor(CAST(2 * sum(CAST(floor(s.price_yes * 10000 + 0.5) AS BIGINT)) + count(*) AS DOUBLE) / (2 * count(*))) / CAST(10000 AS DOUBLE) AS price_yes_avg, count(*) AS n FROM current_links l JOIN providers p ON p.provider_id = l.provider_id JOIN snapshots s ON s.market_id = l.market_id WHERE l.family_id BETWEEN 1 AND 20 GROUP BY 1, 2",
    "freshness": lambda d: f"SELECT l.provider_id, max(s.observed_us) AS last_us, CAST(floor((max(a.now_us) - max(s.observed_us)) / 1000000) AS BIGINT) AS lag_s FROM current_links l JOIN snapshots s ON s.market_id = l.market_id CROSS JOIN (SELECT max(observed_us) AS now_us FROM snapshots) AS a WHERE s.observed_us > a.now_us - 30 * {DAY_US} GROUP BY l.provider_id",
    "frontier": lambda d: "SELECT f.label, a.market_id AS market_1, b.market_id AS market_2, e.slug, round(greatest(a.confidence, b.confidence), 4) AS best FROM current_links a JOIN current_links b ON a.family_id = b.family_id AND a.provider_id <> b.provider_id JOIN families f ON f.family_id = a.family_id LEFT JOIN canonical_events e ON e.event_id = f.event_id WHERE a.provider_id = 1 AND b.provider_id = 2 AND a.relationship_type IN ('identical', 'equivalent') AND b.relationship_type IN ('identical', 'equivalent') ORDER BY greatest(a.confidence, b.confidence) DESC, a.market_id, b.market_id LIMIT 200",
    "uptime": lambda d: f"WITH b AS (SELECT DISTINCT CAST(floor(placed_us / {DAY_US}) AS BIGINT) AS bucket FROM mm_orders), r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b), t AS (SELECT hi - lo + 1 AS total FROM r) SELECT total AS total_windows, (SELECT count(*) FROM b) AS active_windows, total - (SELECT count(*) FROM b) AS dormant_windows, round(100 * CAST((SELECT count(*) FROM b) AS DOUBLE) / total, 2) AS uptime_pct FROM t",
}
# A continued WITH list: "WITH a AS (...) , b AS (...) SELECT" reads the same as one list.
