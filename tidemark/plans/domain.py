"""Domain tables, derived from the test tables by the same arithmetic in both engines.

Venue 1 is an exchange that quotes bids, venue 2 one that quotes asks. Times are microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialect import Dialect, Text, with_tables

#: Order in which the relationship types sort, and their weights in a consensus.
RELATIONSHIPS = {"identical": (0, 1.0), "equivalent": (1, 1.0), "proxy": (2, 0.5), "correlated": (3, 0.25)}

TABLES: dict[str, tuple[Text, tuple[str, ...]]] = {
    "providers": (lambda d: "SELECT * FROM (VALUES (1, 'exch'), (2, 'pool')) AS p(provider_id, provider)", ()),
    "spreads": (
        lambda d: f"""SELECT event_id AS id, event_type AS event_id, concat('c', user_id % 3) AS candidate, {d.us("ts")} AS observed_us,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE round((value % 100) / 100, 4) END AS bid_1,
        round(((value * 7) % 100) / 100, 4) AS ask_2, props AS source_meta FROM {d.table("events")}""",
        ("events",),
    ),
    "snapshots": (
        lambda d: f"""SELECT event_id AS snapshot_id, user_id AS market_id, {d.us("ts")} AS observed_us, round((value % 100) / 100, 4) AS price_yes,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 50 + 1 AS DOUBLE) END AS liquidity,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 900 AS DOUBLE) END AS volume_24h,
        CASE event_id % 4 WHEN 0 THEN 'mid' WHEN 1 THEN 'last' WHEN 2 THEN 'book' ELSE NULL END AS price_source FROM {d.table("events")}""",
        ("events",),
    ),
    "markets": (
        lambda d: f"""SELECT p_partkey AS market_id, 1 + p_partkey % 2 AS provider_id, concat(p_type, '#', p_partkey) AS market_ref, p_brand AS category, p_name AS title,
        concat('ev', p_partkey % 97) AS event_ref, CASE WHEN p_partkey % 5 = 0 THEN 'closed' WHEN p_partkey % 2 = 0 THEN 'active' ELSE 'open' END AS status,
        CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'nfl' WHEN 2 THEN 'nba' WHEN 3 THEN NULL WHEN 4 THEN 'mlb' ELSE 'nhl' END AS sport,
        CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(19700 + p_partkey % 40 AS INT) END AS game_day,
        1704067200000000 + (p_partkey % 365) * 86400000000 AS close_us, 1700000000000000 + p_partkey * 3600000000 AS first_seen_us,
        1700000000000000 + p_partkey * 7200000000 AS last_seen_us, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'winner' WHEN 2 THEN 'total' WHEN 3 THEN 'spread' ELSE 'draw' END AS template,
        p_size AS size, p_retailprice AS volume FROM {d.table("part")}""",
        ("part",),
    ),
    "links": (
        lambda d: f"""SELECT p_partkey * 4 + v AS link_id, CAST(floor(p_partkey / 3) AS BIGINT) AS family_id, p_partkey AS market_id, 1 + p_partkey % 2 AS provider_id, v AS link_version,
        CASE WHEN v = 3 AND p_partkey % 4 = 1 THEN 'removed' WHEN p_partkey % 9 = 0 THEN 'inactive' ELSE 'active' END AS status,
        CASE (CAST(floor(p_partkey / 3) AS BIGINT) + v) % 4 WHEN 0 THEN 'identical' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'proxy' ELSE 'correlated' END AS relationship_type,
        CAST(p_partkey % 89 AS DOUBLE) / 100 + 0.1 AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'seed' END AS link_source,
        1700000000000000 + p_partkey * 60000000 AS created_us
        FROM {d.table("part")} CROSS JOIN {d.span("1", "3", "v")} AS n WHERE v <= 1 + p_partkey % 3 AND p_partkey % 10 <> 7""",
        ("part",),
    ),
    "current_links": (
        lambda d: """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family_id, market_id ORDER BY link_version DESC) AS rn
        FROM links WHERE status <> 'removed') AS x WHERE rn = 1""",
        (),
    ),
    "families": (
        lambda d: f"""SELECT DISTINCT CAST(floor(p_partkey / 3) AS BIGINT) AS family_id, concat('family ', CAST(floor(p_partkey / 3) AS BIGINT)) AS label,
        CAST(floor(p_partkey / 3) AS BIGINT) % 53 AS event_id FROM {d.table("part")}""",
        ("part",),
    ),
    "canonical_events": (
        lambda d: """SELECT e AS event_id, concat('event-', e) AS slug, CASE e % 3 WHEN 0 THEN 'politics' WHEN 1 THEN 'sports' ELSE 'crypto' END AS event_category,
        CASE WHEN e % 7 = 0 THEN NULL ELSE CAST(19700 + e % 40 AS INT) END AS event_day, concat('sub', e % 4) AS subcategory FROM """ + d.span("0", "49", "e") + " AS n",
        (),
    ),
    "proposals": (
        lambda d: f"""SELECT p_partkey AS proposal_id, p_partkey AS market_a, p_partkey + CASE WHEN p_partkey % 5 = 2 THEN 3 ELSE 1 END AS market_b, CAST((p_partkey * 37) % 100 AS DOUBLE) / 100 AS confidence,
        CASE p_partkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'skipped' END AS decision,
        CASE WHEN p_partkey % 3 = 0 THEN 'proxy' ELSE 'equivalent' END AS proposed_type, p_brand AS category,
        1700000000000000 + p_partkey * 90000000 AS created_us, 1700000000000000 + p_partkey * 95000000 AS reviewed_us,
        CASE WHEN p_partkey % 4 = 1 THEN concat('reason ', p_partkey % 6) END AS reason FROM {d.table("part")}""",
        ("part",),
    ),
    "slots": (
        lambda d: """SELECT market_id, CAST(floor(market_id / 2) AS BIGINT) AS slot_id, provider_id, template, category, CASE WHEN market_id % 7 = 0 THEN 'tie ends' ELSE title END AS title,
        CAST(market_id % 100 AS DOUBLE) / 100 AS confidence FROM markets WHERE market_id % 11 <> 4""",
        (),
    ),
    "mm_orders": (
        lambda d: f"""SELECT o_orderkey AS order_id, o_custkey % 50 AS market_id, {d.us("o_orderdate")} AS placed_us,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'rejected' END AS status, CAST(o_orderkey % 90 + 5 AS INT) AS price_cents,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) END AS fair_at_place, CAST(o_orderkey % 40 + 1 AS DOUBLE) AS size,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('x', o_orderkey) END AS exchange_id FROM {d.table("orders")}""",
        ("orders",),
    ),
    "mm_fills": (
        lambda d: f"""SELECT l_orderkey * 8 + l_linenumber AS fill_id, l_orderkey AS order_id, l_suppkey AS market_id, {d.us("l_shipdate")} + l_linenumber * 60000000 AS observed_us,
        CASE WHEN l_returnflag = 'A' THEN 'yes_buy' WHEN l_returnflag = 'R' THEN 'yes_sell' WHEN l_linestatus = 'O' THEN 'no_buy' ELSE 'no_sell' END AS side,
        CAST(floor(l_discount * 1000 + 0.5) AS INT) % 99 + 1 AS price_cents, l_quantity AS size, CAST((l_orderkey * 13 + l_linenumber) % 97 + 1 AS DOUBLE) AS fair,
        CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST((l_orderkey * 7 + l_linenumber) % 21 - 10 AS DOUBLE) END AS adverse_5m,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE round(l_tax * 10, 4) END AS fee_cents FROM {d.table("lineitem")}""",
        ("lineitem",),
    ),
    "depth": (
        lambda d: f"""SELECT event_id AS depth_id, user_id AS market_id, {d.us("ts")} AS observed_us, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 98 + 1 AS DOUBLE) END AS mid_cents,
        CAST(event_id % 6 + 1 AS INT) AS spread_cents FROM {d.table("events")}""",
        ("events",),
    ),
    "heartbeats": (
        lambda d: f"""SELECT CAST(floor({d.us("ts")} / 3600000000) AS BIGINT) * 3600000000 AS cycle_us, CAST(count(*) AS BIGINT) AS attempted,
        CAST(sum(CASE WHEN event_id % 10 < 9 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(count(*) + 2 AS BIGINT) AS configured,
        CAST(sum(CASE WHEN event_id % 10 = 9 AND user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors_1,
        CAST(sum(CASE WHEN event_id % 10 = 9 AND user_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors_2,
        CAST(sum(CASE WHEN event_id % 10 = 9 AND user_id % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS errors_spread FROM {d.table("events")} GROUP BY 1""",
        ("events",),
    ),
    "requests": (
        lambda d: f"""SELECT concat('/v1/', event_type) AS path, {d.us("ts")} AS at_us, CAST(event_id % 700 AS INT) AS latency_ms,
        CASE WHEN event_id % 29 = 0 THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status FROM {d.table("events")}""",
        ("events",),
    ),
    "wallet_trades": (
        lambda d: f"""SELECT event_id AS trade_id, event_id + 1000 AS block_number, concat('m', user_id % 20) AS market, CAST(user_id % 2 AS INT) AS outcome_index, {d.us("ts")} AS at_us,
        CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round(value, 4) AS usdc, CASE WHEN user_id % 10 < 2 THEN 'sharp' ELSE 'degen' END AS cohort FROM {d.table("events")}""",
        ("events",),
    ),
    "outcomes": (lambda d: "SELECT market_id, CASE WHEN market_id % 2 = 0 THEN 'yes' ELSE 'no' END AS outcome FROM markets WHERE market_id % 6 = 0", ()),
}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the domain tables as a DataFrame."""
    return spark.sql(with_tables(Dialect(True, sf_dir), f"SELECT * FROM {name}", TABLES))
