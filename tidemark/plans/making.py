"""Market making: fills, positions, PnL, toxicity of flow, watchdogs, reconciliation."""

from __future__ import annotations

from .dialect import Text

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
_FILL_NOW = "(SELECT max(observed_us) AS now_us FROM mm_fills)"
_SIGNED = "CASE side WHEN 'yes_buy' THEN size WHEN 'yes_sell' THEN -size WHEN 'no_buy' THEN -size ELSE size END"
_CAPTURE = "CASE side WHEN 'yes_buy' THEN (fair - price_cents) * size WHEN 'yes_sell' THEN (price_cents - fair) * size WHEN 'no_buy' THEN ((100 - fair) - price_cents) * size ELSE (price_cents - (100 - fair)) * size END"
_FEE = "coalesce(fee_cents, ceil(0.0175 * size * (price_cents / 100.0) * (1 - price_cents / 100.0) * 100 - 0.000000000001))"
_LAST_MID = "(SELECT market_id, mid_cents FROM (SELECT market_id, mid_cents, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, depth_id DESC) AS rn FROM depth WHERE mid_cents IS NOT NULL) AS d WHERE rn = 1)"

QUERIES: dict[str, Text] = {
    "order_fill_state": lambda d: "SELECT f.order_id, sum(f.size) AS total_size, max(f.observed_us) AS last_us, CAST(floor(sum(f.price_cents * f.size) / nullif(sum(f.size), 0) + 0.5) AS BIGINT) AS vwap_px, CASE WHEN sum(f.size) >= max(o.size) - 0.000000001 THEN 'filled' WHEN sum(f.size) > 0 THEN 'partial' ELSE 'open' END AS state FROM mm_fills f JOIN mm_orders o ON o.order_id = f.order_id GROUP BY f.order_id",
    "spread_capture": lambda d: f"SELECT fill_id, {_CAPTURE} AS capture_cents, {_SIGNED} AS net_delta, CASE WHEN side IN ('yes_buy', 'no_sell') THEN 1 ELSE -1 END AS side_sign, {_FEE} AS fee FROM mm_fills",
    "market_pnl": lambda d: f"WITH f AS (SELECT market_id, sum({_CAPTURE}) AS capture, sum(coalesce(adverse_5m, 0) * size) AS adverse, sum({_FEE}) AS fees, sum({_SIGNED}) AS net, sum(price_cents * size) / nullif(sum(size), 0) AS avg_cost FROM mm_fills GROUP BY market_id), m AS {_LAST_MID} SELECT f.market_id, round(capture, 4) AS spread_capture, round(adverse, 4) AS adverse_selection, round(fees, 4) AS fees, round((m.mid_cents - avg_cost) * net, 4) AS inventory_drift, round(capture + adverse + coalesce((m.mid_cents - avg_cost) * net, 0) - fees, 4) AS net_pnl FROM f LEFT JOIN m ON m.market_id = f.market_id",
    "portfolio_daily_pnl": lambda d: f"WITH t AS (SELECT market_id, observed_us, fill_id, sum({_CAPTURE}) OVER (PARTITION BY market_id ORDER BY observed_us, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cents FROM mm_fills), d AS (SELECT CAST(floor(max(observed_us) / {DAY_US}) AS BIGINT) * {DAY_US} AS start_us FROM mm_fills), r AS (SELECT market_id, cents, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, fill_id DESC) AS rn FROM t CROSS JOIN d WHERE observed_us >= start_us) SELECT round(coalesce(sum(cents), 0), 4) AS cents, count(*) AS markets FROM r WHERE rn = 1",
    "flow_toxicity": lambda d: f"SELECT market_id, count(*) AS n, round(sum(adverse_5m) / nullif(CAST(count(adverse_5m) AS DOUBLE), 0), 6) AS mean_adverse, round(coalesce(sum(adverse_5m), 0) / CAST(count(*) AS DOUBLE) * sqrt(count(*)) / 10, 6) AS score FROM mm_fills WHERE observed_us > (SELECT max(observed_us) FROM mm_fills) - 365 * {DAY_US} GROUP BY market_id",
    "consecutive_adverse": lambda d: "WITH t AS (SELECT market_id, adverse_5m, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, fill_id DESC) AS rn FROM mm_fills WHERE adverse_5m IS NOT NULL) SELECT market_id, count(*) = 2 AND bool_and(adverse_5m > 0) AS tripped FROM t WHERE rn <= 2 GROUP BY market_id",
    "reject_ratio": lambda d: "SELECT market_id, count(*) AS n, count(*) FILTER (WHERE status = 'rejected') AS rejected, round(count(*) FILTER (WHERE status = 'rejected') / CAST(count(*) AS DOUBLE), 4) AS ratio FROM mm_orders GROUP BY market_id HAVING count(*) > 20",
    "adverse_markets": lambda d: "SELECT market_id, count(*) AS n, round(avg(adverse_5m), 6) AS mean_adverse FROM mm_fills WHERE adverse_5m IS NOT NULL GROUP BY market_id HAVING count(*) >= 10 AND avg(adverse_5m) < -0.1",
    "watchdog_stats": lambda d: f"WITH n AS (SELECT max(placed_us) AS now_us FROM mm_orders), o AS (SELECT market_id, count(*) FILTER (WHERE placed_us > now_us - 400 * {DAY_US}) AS orders_4h, count(*) FILTER (WHERE placed_us > now_us - 100 * {DAY_US}) AS orders_1h, count(*) FILTER (WHERE placed_us > now_us - 100 * {DAY_US} AND status = 'rejected') AS rejects_1h FROM mm_orders CROSS JOIN n GROUP BY market_id), f AS (SELECT market_id, count(*) AS fills_4h FROM mm_fills GROUP BY market_id) SELECT o.market_id, orders_4h, orders_1h, rejects_1h, coalesce(fills_4h, 0) AS fills_4h, CASE WHEN orders_4h >= 50 AND coalesce(fills_4h, 0) / CAST(orders_4h AS DOUBLE) < 0.0005 THEN 'fill_rate' WHEN orders_1h >= 20 AND rejects_1h / CAST(orders_1h AS DOUBLE) > 0.5 THEN 'reject_rate' END AS alert FROM o LEFT JOIN f ON f.market_id = o.market_id",
    "stream_heartbeat": lambda d: f"SELECT (SELECT count(*) FROM mm_orders WHERE placed_us > (SELECT max(placed_us) FROM mm_orders) - 30 * {DAY_US}) AS new_orders, (SELECT count(*) FROM mm_orders WHERE status = 'open') AS open_orders, (SELECT count(*) FROM depth WHERE mid_cents IS NOT NULL) AS depth_rows, (SELECT max(placed_us) FROM mm_orders) AS latest_order_us",
    "reconcile_orders": lambda d: "WITH x AS (SELECT exchange_id, order_id FROM mm_orders WHERE exchange_id IS NOT NULL AND order_id % 10 <> 0), y AS (SELECT exchange_id, status FROM mm_orders WHERE exchange_id IS NOT NULL AND status = 'open') SELECT coalesce(x.exchange_id, y.exchange_id) AS exchange_id, CASE WHEN y.exchange_id IS NULL THEN 'only_exchange' WHEN x.exchange_id IS NULL THEN 'only_db' ELSE 'both' END AS side FROM x FULL OUTER JOIN y ON x.exchange_id = y.exchange_id",
    "reconcile_fills": lambda d: "SELECT f.fill_id, abs(f.size - g.l_quantity) > 0.000001 AS size_differs, f.side <> CASE WHEN g.l_returnflag = 'A' THEN 'yes_buy' WHEN g.l_returnflag = 'R' THEN 'yes_sell' ELSE 'no_buy' END AS side_differs FROM mm_fills f JOIN " + d.table("lineitem") + " g ON g.l_orderkey * 8 + g.l_linenumber = f.fill_id",
    "fair_at_place": lambda d: "SELECT f.fill_id, coalesce(o.fair_at_place, f.fair) AS fair FROM mm_fills f LEFT JOIN mm_orders o ON o.order_id = f.order_id",
    "fee_backfill": lambda d: f"SELECT fill_id, {_FEE} AS fee FROM mm_fills WHERE fee_cents IS NULL",
    "pending_reaper": lambda d: f"SELECT order_id, CASE WHEN exchange_id IS NULL AND status = 'open' AND placed_us < (SELECT max(placed_us) FROM mm_orders) - 30 * {DAY_US} THEN 'rejected' ELSE status END AS status FROM mm_orders",
    "settle_positions": lambda d: f"WITH p AS (SELECT market_id, sum({_SIGNED}) AS net, sum(price_cents * size) / nullif(sum(size), 0) AS avg_cost FROM mm_fills GROUP BY market_id) SELECT p.market_id, round(p.net * (CASE o.outcome WHEN 'yes' THEN 100 ELSE 0 END - p.avg_cost), 4) AS settled_cents FROM p JOIN outcomes o ON o.market_id = p.market_id",
    "mid_age_bands": lambda d: "SELECT CASE WHEN mid_cents IS NULL THEN 'missing' WHEN mid_cents < 20 THEN 'low' WHEN mid_cents > 80 THEN 'high' ELSE 'middle' END AS band, count(*) AS n, round(avg(spread_cents), 6) AS mean_spread FROM depth GROUP BY 1",
    "position_limits": lambda d: "SELECT fill_id, CAST(least(greatest(floor(3000.0 / price_cents), 5), 60) AS INT) AS hard_limit FROM mm_fills",
    "seven_day_test": lambda d: f"SELECT CAST(floor(observed_us / {DAY_US}) AS BIGINT) AS day, round(sum({_CAPTURE}), 4) AS net, count(*) FILTER (WHERE price_cents * size > 3000) AS notional_breaches, round(count(adverse_5m) / CAST(count(*) AS DOUBLE), 4) AS known_fraction FROM mm_fills GROUP BY 1",
    "previous_opposite_fill": lambda d: "WITH f AS (SELECT *, CASE WHEN side IN ('yes_buy', 'no_sell') THEN 1 ELSE -1 END AS dir FROM mm_fills), r AS (SELECT *, max(CASE WHEN dir = 1 THEN observed_us END) OVER w AS last_long, max(CASE WHEN dir = -1 THEN observed_us END) OVER w AS last_short FROM f WINDOW w AS (PARTITION BY market_id ORDER BY observed_us, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT fill_id, CASE WHEN dir = 1 THEN last_short ELSE last_long END AS opposite_us FROM r",
    "reject_burst": lambda d: f"SELECT order_id, count(*) OVER (PARTITION BY market_id ORDER BY placed_us RANGE BETWEEN {60 * DAY_US} PRECEDING AND CURRENT ROW) AS failures, count(*) OVER (PARTITION BY market_id ORDER BY placed_us RANGE BETWEEN {60 * DAY_US} PRECEDING AND CURRENT ROW) > 10 AS skip FROM mm_orders WHERE status = 'rejected'",
    "blocklist_upsert": lambda d: "WITH old AS (SELECT market_id, max(close_us) AS expires_us, 'old' AS notes FROM markets WHERE market_id % 3 = 0 GROUP BY market_id), new AS (SELECT market_id, max(last_seen_us) AS expires_us, CASE WHEN market_id % 2 = 0 THEN 'new' END AS notes FROM markets WHERE market_id % 2 = 0 GROUP BY market_id) SELECT coalesce(o.market_id, n.market_id) AS market_id, greatest(o.expires_us, n.expires_us) AS expires_us, coalesce(n.notes, o.notes) AS notes FROM old o FULL OUTER JOIN new n ON n.market_id = o.market_id",
}
