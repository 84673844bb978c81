"""Coverage, links, review, health and audits of the market tables."""

from __future__ import annotations

from .dialect import Text

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
_LINKED = "(SELECT DISTINCT market_id FROM current_links)"
_NOW = "(SELECT max(observed_us) AS now_us FROM snapshots)"

QUERIES: dict[str, Text] = {
    "providers_list": lambda d: "SELECT p.provider_id, p.provider, count(m.market_id) AS markets, max(m.last_seen_us) AS last_seen_us FROM providers p LEFT JOIN markets m ON m.provider_id = p.provider_id GROUP BY p.provider_id, p.provider",
    "coverage_summary": lambda d: "SELECT m.provider_id, count(*) AS total_markets, count(x.market_id) AS linked_markets, count(*) - count(x.market_id) AS unlinked_markets, round(count(x.market_id) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS coverage_ratio FROM markets m LEFT JOIN (SELECT DISTINCT market_id FROM current_links WHERE status = 'active') AS x ON x.market_id = m.market_id GROUP BY m.provider_id",
    "coverage_by_category": lambda d: "SELECT m.category, count(DISTINCT m.market_id) AS total_markets, count(DISTINCT l.market_id) AS linked FROM markets m LEFT JOIN links l ON l.market_id = m.market_id AND l.status = 'active' GROUP BY m.category",
    "unlinked_markets": lambda d: "SELECT m.market_id, m.market_ref, m.status, m.last_seen_us FROM markets m LEFT JOIN (SELECT DISTINCT market_id FROM current_links WHERE status = 'active') AS x ON x.market_id = m.market_id WHERE x.market_id IS NULL AND m.provider_id = 1 ORDER BY m.last_seen_us DESC NULLS LAST, m.market_id LIMIT 300",
    "new_markets": lambda d: f"SELECT market_id, market_ref, category, first_seen_us FROM markets WHERE first_seen_us >= 1700000000000000 + 30 * {DAY_US} ORDER BY first_seen_us DESC, market_id LIMIT 100",
    "current_links_view": lambda d: "SELECT family_id, market_id, link_version, status, relationship_type FROM current_links",
    "links_for_family": lambda d: "SELECT l.link_id, l.family_id, p.provider, m.market_ref, l.relationship_type, l.status FROM current_links l JOIN providers p ON p.provider_id = l.provider_id JOIN markets m ON m.market_id = l.market_id WHERE l.family_id BETWEEN 10 AND 40",
    "links_history": lambda d: "SELECT l.link_id, p.provider, m.title, f.label, e.slug, l.link_version, l.status, l.created_us FROM links l JOIN providers p ON p.provider_id = l.provider_id JOIN markets m ON m.market_id = l.market_id JOIN families f ON f.family_id = l.family_id JOIN canonical_events e ON e.event_id = f.event_id WHERE l.status = 'active' ORDER BY l.created_us DESC, l.link_id DESC LIMIT 100 OFFSET 50",
    "links_history_count": lambda d: "SELECT count(*) AS total FROM links l JOIN markets m ON m.market_id = l.market_id JOIN families f ON f.family_id = l.family_id JOIN canonical_events e ON e.event_id = f.event_id WHERE l.status = 'active'",
    "review_queue": lambda d: "SELECT pr.proposal_id, a.title AS title_a, b.title AS title_b, pa.provider AS provider_a, pb.provider AS provider_b, pr.confidence FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b JOIN providers pa ON pa.provider_id = a.provider_id JOIN providers pb ON pb.provider_id = b.provider_id WHERE pr.decision IS NULL AND pr.confidence >= 0.5 ORDER BY pr.confidence DESC, pr.proposal_id LIMIT 100",
    "undecided_cross_provider": lambda d: "SELECT pr.proposal_id, pr.confidence FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b WHERE pr.decision IS NULL AND a.provider_id <> b.provider_id AND coalesce(a.sport, 'unknown') = coalesce(b.sport, 'unknown') ORDER BY pr.confidence DESC, pr.proposal_id LIMIT 800",
    "sports_batch_accept": lambda d: "SELECT pr.proposal_id, abs(a.game_day - b.game_day) AS days FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b WHERE a.game_day IS NOT NULL AND b.game_day IS NOT NULL AND abs(a.game_day - b.game_day) <= 1 AND pr.decision IS NULL",
    "accept_time_availability": lambda d: f"SELECT l.market_id, count(s.snapshot_id) AS n, count(s.snapshot_id) >= 2 AS available FROM current_links l LEFT JOIN snapshots s ON s.market_id = l.market_id AND s.observed_us > 1704067200000000 GROUP BY l.market_id",
    "stale_markets": lambda d: f"SELECT m.market_id, m.market_ref, CASE WHEN EXISTS (SELECT 1 FROM current_links l WHERE l.market_id = m.market_id AND l.relationship_type = 'identical') THEN 0 ELSE 1 END AS priority FROM markets m WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.market_id = m.market_id AND s.liquidity > 10) ORDER BY 3, 1 LIMIT 500",
    "unmapped_interleave": lambda d: "SELECT m.market_id, m.provider_id, CASE WHEN m.template IN ('winner', 'draw') THEN 0 ELSE 1 END AS h2h_tier, CAST(row_number() OVER (PARTITION BY m.provider_id, CASE WHEN m.template IN ('winner', 'draw') THEN 0 ELSE 1 END ORDER BY CASE WHEN m.sport = 'nfl' THEN 0 WHEN m.sport IS NULL THEN 2 ELSE 1 END, m.last_seen_us DESC NULLS LAST, m.market_id DESC) AS BIGINT) AS provider_rank FROM markets m LEFT JOIN slots s ON s.market_id = m.market_id WHERE s.market_id IS NULL",
    "events_in_window": lambda d: "SELECT m.market_id, e.event_id, abs(m.game_day - e.event_day) AS days FROM markets m JOIN canonical_events e ON e.event_category = CASE WHEN m.sport IS NULL THEN 'crypto' WHEN m.sport = 'unknown' THEN 'politics' ELSE 'sports' END AND e.event_day BETWEEN m.game_day - 1 AND m.game_day + 1",
    "bilateral_families": lambda d: "SELECT family_id, count(*) AS n_links, count(DISTINCT provider_id) AS n_providers FROM current_links GROUP BY family_id HAVING count(DISTINCT provider_id) >= 2 AND count(*) = 2",
    "bilateral_pivot": lambda d: "SELECT l.family_id, max(m.title) FILTER (WHERE p.provider = 'exch') AS title_1, max(m.title) FILTER (WHERE p.provider = 'pool') AS title_2, max(m.close_us) FILTER (WHERE p.provider = 'exch') AS close_1, max(m.close_us) FILTER (WHERE p.provider = 'pool') AS close_2, max(m.volume) FILTER (WHERE p.provider = 'exch') AS volume_1, max(m.volume) FILTER (WHERE p.provider = 'pool') AS volume_2 FROM current_links l JOIN providers p ON p.provider_id = l.provider_id JOIN markets m ON m.market_id = l.market_id GROUP BY l.family_id HAVING count(DISTINCT p.provider) = 2",
    "slot_states": lambda d: "WITH s AS (SELECT slot_id, sum(CASE WHEN provider_id = 1 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN provider_id = 2 THEN 1 ELSE 0 END) AS m FROM slots GROUP BY slot_id) SELECT CASE WHEN k = 1 AND m = 1 THEN 'bilateral' WHEN k > 1 AND m > 1 THEN 'crowded' WHEN k = 0 THEN 'only_2' WHEN m = 0 THEN 'only_1' ELSE 'uneven' END AS slot_state, count(*) AS n, CAST(sum(k + m) AS BIGINT) AS legs FROM s GROUP BY 1",
    "slot_states_per_template": lambda d: "WITH s AS (SELECT slot_id, coalesce(template, 'none') AS template, sum(CASE WHEN provider_id = 1 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN provider_id = 2 THEN 1 ELSE 0 END) AS m FROM slots GROUP BY 1, 2) SELECT template, count(*) FILTER (WHERE k = 1 AND m = 1) AS bilateral, count(*) FILTER (WHERE k = 0 OR m = 0) AS solo FROM s GROUP BY template",
    "slot_bilateral_links": lambda d: "WITH s AS (SELECT slot_id, sum(CASE WHEN provider_id = 1 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN provider_id = 2 THEN 1 ELSE 0 END) AS m, min(confidence) AS conf FROM slots GROUP BY slot_id), taken AS (SELECT DISTINCT s.slot_id FROM slots s JOIN current_links l ON l.market_id = s.market_id WHERE l.relationship_type = 'identical' AND l.status = 'active') SELECT s.slot_id, round(s.conf, 4) AS confidence FROM s LEFT JOIN taken t ON t.slot_id = s.slot_id WHERE k = 1 AND m = 1 AND t.slot_id IS NULL",
    "draw_legs": lambda d: f"WITH s AS (SELECT slot_id, sum(CASE WHEN {d.matches('title', '(tie|draw|green)')} THEN 1 ELSE 0 END) AS draws, count(*) AS legs FROM slots GROUP BY slot_id) SELECT draws, count(*) AS n_slots, CAST(sum(legs) AS BIGINT) AS legs FROM s GROUP BY draws",
    "link_families": lambda d: "WITH f AS (SELECT family_id, bool_or(provider_id = 1) AS has_1, bool_or(provider_id = 2) AS has_2, count(*) AS legs, max(link_version) AS v FROM current_links GROUP BY family_id) SELECT count(*) AS n_families, count(*) FILTER (WHERE has_1 AND has_2) AS bilateral, count(*) FILTER (WHERE NOT (has_1 AND has_2)) AS single_side, CAST(sum(legs) AS BIGINT) AS legs, max(v) AS max_version FROM f",
    "link_versions": lambda d: "SELECT link_version, link_source, count(*) AS n, count(DISTINCT family_id) AS families FROM links GROUP BY 1, 2",
    "next_run_version": lambda d: "SELECT coalesce(max(link_version), 0) + 1 AS next_version FROM links",
    "inactivation_blockers": lambda d: "SELECT m.market_id, count(DISTINCT s.snapshot_id) AS n_snapshots, count(DISTINCT l.link_id) AS n_links FROM markets m LEFT JOIN snapshots s ON s.market_id = m.market_id LEFT JOIN current_links l ON l.market_id = m.market_id WHERE m.status = 'closed' GROUP BY m.market_id HAVING count(DISTINCT s.snapshot_id) > 0 OR count(DISTINCT l.link_id) > 0",
    "orphan_snapshots": lambda d: "SELECT s.market_id, count(*) AS n FROM snapshots s LEFT JOIN markets m ON m.market_id = s.market_id AND m.status <> 'closed' WHERE m.market_id IS NULL GROUP BY s.market_id",
    "data_quality": lambda d: "SELECT 'markets_without_snapshots' AS fact, count(*) AS n FROM markets m WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.market_id = m.market_id) UNION ALL SELECT 'price_out_of_range', count(*) FROM snapshots WHERE price_yes < 0 OR price_yes > 1 UNION ALL SELECT 'duplicate_refs', count(*) FROM (SELECT title FROM markets GROUP BY title HAVING count(*) > 1) AS t UNION ALL SELECT 'orphan_proposals', count(*) FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM markets m WHERE m.market_id = p.market_b)",
    "category_distribution": lambda d: "SELECT m.category, p.provider, count(*) AS n, count(DISTINCT m.event_ref) AS event_refs FROM markets m JOIN providers p ON p.provider_id = m.provider_id GROUP BY m.category, p.provider",
    "rejection_top": lambda d: "SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM proposals WHERE decision = 'rejected' GROUP BY 1",
    "confidence_buckets": lambda d: "SELECT CASE WHEN confidence >= 0.9 THEN '0.9+' WHEN confidence >= 0.8 THEN '0.8-0.9' WHEN confidence >= 0.5 THEN '0.5-0.8' ELSE '<0.5' END AS bucket, count(*) AS n FROM proposals GROUP BY 1",
    "proposal_counters": lambda d: "SELECT proposed_type, coalesce(decision, 'pending') AS decision, count(*) AS n, min(created_us) AS first_us, max(reviewed_us) AS last_us FROM proposals GROUP BY 1, 2",
    "link_rate_by_category": lambda d: "SELECT m.category, count(*) AS n, count(x.market_id) AS linked, round(count(x.market_id) / CAST(count(*) AS DOUBLE), 3) AS link_rate FROM markets m LEFT JOIN (SELECT DISTINCT market_id FROM current_links WHERE relationship_type IN ('identical', 'equivalent')) AS x ON x.market_id = m.market_id GROUP BY m.category",
    "series_top": lambda d: "SELECT event_ref, count(*) AS n, max(last_seen_us) AS last_us FROM markets GROUP BY event_ref ORDER BY n DESC, event_ref LIMIT 50",
    "series_liveness": lambda d: "SELECT event_ref, count(*) FILTER (WHERE status <> 'closed') * 10 - count(*) FILTER (WHERE status = 'closed') - CASE WHEN max(last_seen_us) < 1700000000000000 + 3000 * CAST(3600000000 AS BIGINT) THEN 25 ELSE 0 END AS score FROM markets GROUP BY event_ref",
    "stale_series": lambda d: f"SELECT event_ref, max(last_seen_us) AS last_us FROM markets GROUP BY event_ref HAVING max(last_seen_us) < (SELECT max(last_seen_us) FROM markets) - 7 * {DAY_US}",
    "status_by_provider": lambda d: "SELECT p.provider, m.status, count(*) AS n FROM markets m JOIN providers p ON p.provider_id = m.provider_id GROUP BY 1, 2",
    "active_rule": lambda d: "SELECT provider_id, count(*) AS n FROM markets WHERE (provider_id = 1 AND status = 'active') OR (provider_id = 2 AND status = 'open') OR (provider_id = 2 AND status = 'active') GROUP BY provider_id",
    "sports_violations": lambda d: "SELECT pr.proposal_id, CASE WHEN coalesce(a.sport, 'unknown') <> coalesce(b.sport, 'unknown') THEN 'sport' WHEN abs(a.game_day - b.game_day) > 1 THEN 'date' END AS violation FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b WHERE pr.decision = 'accepted' AND (coalesce(a.sport, 'unknown') <> coalesce(b.sport, 'unknown') OR abs(a.game_day - b.game_day) > 1)",
    "sports_gate": lambda d: "SELECT count(*) FILTER (WHERE status <> 'closed' AND close_us < 1710000000000000) AS stale_active, count(*) FILTER (WHERE sport = 'unknown' OR sport IS NULL) AS unknown_sport, count(*) AS n FROM markets",
    "fuzzy_contains": lambda d: "SELECT e.event_id, count(*) AS n FROM canonical_events e JOIN markets m ON e.event_category = 'sports' AND CAST(regexp_extract(m.event_ref, '([0-9]+)', 1) AS INT) = e.event_id GROUP BY e.event_id",
    "titles_by_topic": lambda d: f"SELECT CASE WHEN {d.matches('lower(title)', '(red|rose|coral)')} THEN 'red' WHEN lower(title) LIKE '%blue%' THEN 'blue' WHEN {d.matches('title', '^[a-m]')} THEN 'a-m' ELSE 'other' END AS topic, count(*) AS n FROM markets GROUP BY 1",
    "snapshot_provenance": lambda d: "SELECT coalesce(price_source, 'none') AS price_source, count(*) AS n, count(DISTINCT market_id) AS markets FROM snapshots GROUP BY 1",
    "round_trip": lambda d: "SELECT p.proposal_id, p.reviewed_us, coalesce(l.links, 0) AS links, coalesce(s.n_snapshots, 0) AS n_snapshots, s.last_us FROM proposals p LEFT JOIN (SELECT market_id, count(*) AS links FROM current_links GROUP BY 1) AS l ON l.market_id = p.market_a LEFT JOIN (SELECT market_id, count(*) AS n_snapshots, max(observed_us) AS last_us FROM snapshots GROUP BY 1) AS s ON s.market_id = p.market_a WHERE p.decision = 'accepted'",
    "mapping_checks": lambda d: "SELECT 'duplicate' AS fact, count(*) AS n FROM (SELECT event_ref, provider_id FROM markets GROUP BY 1, 2 HAVING count(*) > 1) AS t UNION ALL SELECT 'cross_provider', count(*) FROM (SELECT event_ref FROM markets GROUP BY 1 HAVING count(DISTINCT provider_id) > 1) AS t UNION ALL SELECT 'orphan_family', count(*) FROM families f LEFT JOIN canonical_events e ON e.event_id = f.event_id WHERE e.event_id IS NULL",
    "semi_join_union": lambda d: "SELECT market_id, category FROM markets WHERE market_id IN (SELECT market_a FROM proposals WHERE decision = 'accepted' UNION SELECT market_b FROM proposals WHERE decision = 'rejected')",
    "auto_accept_audit": lambda d: "SELECT pr.proposal_id, concat_ws(',', CASE WHEN pr.confidence < 0.75 THEN 'confidence' END, CASE WHEN pr.proposed_type <> 'equivalent' THEN 'type' END, CASE WHEN a.game_day IS NULL OR b.game_day IS NULL THEN 'date' END) AS failed FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b WHERE pr.decision = 'accepted'",
    "auto_accept_rules": lambda d: "SELECT pr.proposal_id, CASE WHEN pr.confidence < 0.75 THEN 'low_confidence' WHEN pr.proposed_type <> 'equivalent' THEN 'not_equivalent' WHEN la.market_id IS NOT NULL OR lb.market_id IS NOT NULL THEN 'already_linked' WHEN abs(a.game_day - b.game_day) > 1 THEN 'date' ELSE 'accept' END AS outcome FROM proposals pr JOIN markets a ON a.market_id = pr.market_a JOIN markets b ON b.market_id = pr.market_b LEFT JOIN (SELECT DISTINCT market_id FROM links WHERE status <> 'removed') AS la ON la.market_id = pr.market_a LEFT JOIN (SELECT DISTINCT market_id FROM links WHERE status <> 'removed') AS lb ON lb.market_id = pr.market_b WHERE pr.decision IS NULL",
    "events_from_fixtures": lambda d: "SELECT sport, game_day, event_ref, count(*) AS n, min(market_id) AS first_market FROM markets WHERE sport IS NOT NULL AND sport <> 'unknown' AND game_day IS NOT NULL GROUP BY 1, 2, 3",
    "dominant_sport": lambda d: "SELECT event_ref, sport FROM (SELECT event_ref, sport, row_number() OVER (PARTITION BY event_ref ORDER BY count(*) DESC, sport) AS rn FROM markets WHERE sport IS NOT NULL GROUP BY event_ref, sport) AS t WHERE rn = 1",
    "settings_not_listed": lambda d: "SELECT m.market_id FROM markets m WHERE m.template IS NOT NULL AND NOT EXISTS (SELECT 1 FROM proposals p WHERE p.market_a = m.market_id AND p.decision = 'accepted')",
    "outcome_missing": lambda d: "SELECT m.market_id, m.status FROM markets m WHERE m.status = 'closed' AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.market_id = m.market_id)",
    "observer_health": lambda d: "WITH w AS (SELECT * FROM heartbeats ORDER BY cycle_us DESC LIMIT 200) SELECT count(*) AS cycles, CAST(sum(attempted) AS BIGINT) AS attempted, round(sum(succeeded) / nullif(CAST(sum(attempted) AS DOUBLE), 0), 4) AS success_rate, round(sum(CASE WHEN configured > 0 THEN succeeded ELSE 0 END) / nullif(CAST(sum(configured) AS DOUBLE), 0), 4) AS configured_rate, round(sum(errors_1 + CAST(errors_spread AS DOUBLE) / 2), 4) AS failures_1, round(sum(errors_2 + CAST(errors_spread AS DOUBLE) / 2), 4) AS failures_2 FROM w",
    "usage_by_path": lambda d: f"SELECT path, count(*) AS total_requests, round(avg(latency_ms), 4) AS avg_latency_ms, count(*) FILTER (WHERE status >= 500) AS error_count, max(at_us) AS last_us FROM requests WHERE at_us > (SELECT max(at_us) FROM requests) - 24 * 30 * {HOUR_US} GROUP BY path",
    "request_p95": lambda d: "SELECT path, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p95, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p50 FROM requests GROUP BY path",
    "slo_checks": lambda d: "WITH r AS (SELECT CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p95 FROM requests), h AS (SELECT sum(succeeded) / CAST(sum(attempted) AS DOUBLE) AS rate FROM heartbeats) SELECT p95, p95 <= 500 AS latency_ok, round(rate, 4) AS success_rate, rate >= 0.99 AS success_ok FROM r CROSS JOIN h",
    "runtime_status": lambda d: f"WITH n AS {_NOW} SELECT max(s.observed_us) AS latest, max(s.observed_us) FILTER (WHERE m.provider_id = 1) AS latest_1, max(s.observed_us) FILTER (WHERE m.provider_id = 2) AS latest_2, count(*) AS recent, (SELECT count(*) FROM markets) AS markets_count, (SELECT count(*) FROM current_links) AS links_count FROM snapshots s JOIN markets m ON m.market_id = s.market_id CROSS JOIN n WHERE s.observed_us > n.now_us - 15 * {DAY_US}",
    "flow_rollup": lambda d: "SELECT market, outcome_index, CAST(floor(at_us / 300000000) AS BIGINT) * 300000000 AS bucket_us, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells, round(sum(usdc), 4) AS usdc, round(sum(CASE WHEN cohort = 'sharp' THEN usdc ELSE 0 END), 4) AS sharp_usdc FROM wallet_trades GROUP BY 1, 2, 3",
    "promote_final": lambda d: "SELECT trade_id, block_number, (SELECT max(block_number) FROM wallet_trades) - block_number >= 64 AS final FROM wallet_trades",
    "volume_backfill": lambda d: "WITH v AS (SELECT market_id, volume_24h FROM (SELECT market_id, volume_24h, row_number() OVER (PARTITION BY market_id ORDER BY observed_us DESC, snapshot_id DESC) AS rn FROM snapshots WHERE volume_24h IS NOT NULL) AS t WHERE rn = 1) SELECT m.market_id, coalesce(v.volume_24h, m.volume) AS volume FROM markets m LEFT JOIN v ON v.market_id = m.market_id",
    "clear_stale_proposals": lambda d: "SELECT p.proposal_id, CASE WHEN p.decision IS NULL AND (a.status = 'closed' OR b.status = 'closed') THEN 'skipped' ELSE p.decision END AS decision, CASE WHEN p.decision IS NULL AND (a.status = 'closed' OR b.status = 'closed') THEN concat(coalesce(p.reason, ''), '|stale') ELSE p.reason END AS reason FROM proposals p JOIN markets a ON a.market_id = p.market_a JOIN markets b ON b.market_id = p.market_b",
    "stale_close": lambda d: "SELECT m.market_id, CASE WHEN m.status <> 'closed' AND m.close_us < 1710000000000000 AND l.market_id IS NULL THEN 'closed' ELSE m.status END AS status FROM markets m LEFT JOIN (SELECT DISTINCT market_id FROM current_links WHERE status = 'active' AND relationship_type = 'identical') AS l ON l.market_id = m.market_id",
    "snapshot_retention": lambda d: f"SELECT count(*) AS kept, min(observed_us) AS oldest FROM snapshots WHERE observed_us >= (SELECT max(observed_us) FROM snapshots) - 30 * {DAY_US}",
    "sample_by_hash": lambda d: "SELECT market_id, md5(concat(market_id, ':seed7')) AS h FROM markets ORDER BY md5(concat(market_id, ':seed7')), market_id LIMIT 200",
    "vocabulary_nulls": lambda d: "SELECT category, coalesce(template, 'none') AS template, count(*) AS n, min(market_id) AS sample_id, round(count(*) FILTER (WHERE template IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS rate FROM markets GROUP BY 1, 2",
    "topic_health": lambda d: "SELECT p.provider, m.category, coalesce(m.sport, 'none') AS subject, count(DISTINCT m.event_ref) AS events, count(*) AS markets FROM markets m JOIN providers p ON p.provider_id = m.provider_id GROUP BY 1, 2, 3",
    "stale_share": lambda d: f"WITH l AS (SELECT market_id, max(observed_us) AS last_us FROM depth GROUP BY market_id), n AS (SELECT max(last_us) AS now_us FROM l) SELECT count(*) AS markets, count(*) FILTER (WHERE now_us - last_us > {HOUR_US}) AS stale, round(count(*) FILTER (WHERE now_us - last_us > {HOUR_US}) / CAST(count(*) AS DOUBLE), 6) AS share, count(*) FILTER (WHERE now_us - last_us > {HOUR_US}) * 2 > count(*) AS alarm FROM l CROSS JOIN n",
}
