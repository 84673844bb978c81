"""Queries that callers narrow down: what is not given is not asked for, and not joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import instruments, money, refs, text
from ..operators.asof import asof_last
from ..operators.candidates import best_in_bucket, capped, first_by_key, within_share
from ..operators.folds import positions
from .domain import domain

NOW_US = 1_705_000_000_000_000
#: Rows of a page, pairs of a block and proposals of a run, at most.
MOST_ROWS, PER_BLOCK, PER_RUN = 200, 50, 200
#: Microseconds after a fill at which the market is looked at again.
HORIZONS = {"1m": 60_000_000, "5m": 300_000_000, "30m": 1_800_000_000}


def links_page(spark: SparkSession, sf_dir: str, *, status: str | None = None, category: str | None = None, slug: str | None = None, since: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the links, latest first. Events are joined only where a slug is asked for."""
    limit, offset = refs.page(limit, offset, MOST_ROWS)
    at = refs.since_us(since, NOW_US)
    rows = domain(spark, sf_dir, "links").join(domain(spark, sf_dir, "markets").select("market_id", "title", "category"), "market_id")
    for column, wanted in (("status", status), ("category", category)):
        rows = rows.where(F.col(column) == wanted) if wanted is not None else rows
    rows = rows.where(F.col("created_us") >= at) if at is not None else rows
    if slug is not None:
        events = domain(spark, sf_dir, "canonical_events").where(F.col("slug") == slug).select("event_id")
        rows = rows.join(domain(spark, sf_dir, "families").join(events, "event_id").select("family_id"), "family_id")
    rows = rows.select("link_id", "family_id", "market_id", "title", "category", "status", "created_us")
    return rows.orderBy(F.desc("created_us"), F.desc("link_id")).offset(offset).limit(limit)


def open_markets(spark: SparkSession, sf_dir: str, *, now_us: int = NOW_US, contains: str | None = None, sport: str | None = None) -> DataFrame:
    """Markets that have not closed, are no binary slot, hold a text and are of a sport: of all sports where none is of it."""
    rows = domain(spark, sf_dir, "markets").where(F.col("close_us").isNull() | (F.col("close_us") > now_us))
    rows = rows.where(~refs.is_binary_slot(F.col("market_ref")))
    if contains is not None:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "market_ref", "title", "event_ref")), F.lit(contains.lower())))
    if sport is not None:
        any_ = rows.agg(F.coalesce(F.max(F.col("sport") == sport), F.lit(False)).alias("_any"))
        rows = rows.crossJoin(F.broadcast(any_)).where(~F.col("_any") | (F.col("sport") == sport)).drop("_any")  # one row
    return rows.select("market_id", refs.slug_of(F.col("market_ref")).alias("slug"), refs.outcome_of(F.col("market_ref")).alias("outcome"), refs.anchor_day(F.col("game_day"), F.col("close_us")).alias("anchor_day"))


OPEN_MARKETS = f"""SELECT market_id, split_part(market_ref, '#', 1) AS slug, split_part(market_ref, '#', 2) AS outcome, coalesce(game_day, CAST(floor(close_us / 86400000000) AS INT)) AS anchor_day
FROM markets WHERE close_us > {NOW_US} AND strpos(lower(concat_ws(' ', market_ref, title, event_ref)), 'ring') > 0 AND sport = 'nfl'"""


def proposals_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listing of venue 1 the most similar title of venue 2 in its bucket, with its confidence; the best of a block
    and of the run go on."""
    m = domain(spark, sf_dir, "markets").withColumn("bucket", F.concat_ws("|", "event_ref", "category"))
    a = m.where("provider_id = 1").select("bucket", F.col("market_id").alias("left_id"), text.tokens(F.col("title")).alias("a"))
    b = m.where("provider_id = 2").select("bucket", F.col("market_id").alias("right_id"), text.tokens(F.col("title")).alias("b"))
    best = best_in_bucket(a, b, "bucket", F.round(text.jaccard(F.col("a"), F.col("b")), 6), refs.LEAST_TITLE_SIMILARITY)
    best = best.withColumn("confidence", F.round(refs.title_confidence(F.col("similarity"), "crypto"), 6)).join(a.select("left_id", "bucket"), "left_id")
    return capped(best, "bucket", "confidence", ["left_id"], PER_BLOCK, PER_RUN)


def strike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the two venues on one event whose strikes agree to a hundredth."""
    m = domain(spark, sf_dir, "markets")
    a = m.where("provider_id = 1").select("event_ref", F.col("market_id").alias("left_id"), F.col("volume").alias("a"))
    b = m.where("provider_id = 2").select("event_ref", F.col("market_id").alias("right_id"), F.col("volume").alias("b"))
    return within_share(a, b, ["event_ref"], "a", "b", 0.01).select("left_id", "right_id")


STRIKES = """SELECT a.market_id AS left_id, b.market_id AS right_id FROM markets a JOIN markets b ON a.event_ref = b.event_ref AND a.provider_id = 1 AND b.provider_id = 2
WHERE abs(a.volume - b.volume) / greatest(a.volume, b.volume) < 0.01"""


def dual_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing of venue 1 with the first of venue 2 whose first title word, brand and size are the same."""
    key = F.concat_ws("|", F.lower(F.substring_index("title", " ", 1)), "category", "size")
    m = domain(spark, sf_dir, "markets").withColumn("key", key)
    a = m.where("provider_id = 1").select("key", F.col("market_id").alias("left_id"))
    return first_by_key(a, m.where("provider_id = 2").select("key", F.col("market_id").alias("right_id")), "key", "right_id").drop("key")


DUAL = """WITH k AS (SELECT market_id, provider_id, concat_ws('|', lower(split_part(title, ' ', 1)), category, size) AS key FROM markets),
b AS (SELECT key, min(market_id) AS right_id FROM k WHERE provider_id = 2 GROUP BY key) SELECT k.market_id AS left_id, b.right_id FROM k JOIN b ON b.key = k.key WHERE k.provider_id = 1"""


def post_fill_mids(spark: SparkSession, sf_dir: str, *, now_us: int = NOW_US) -> DataFrame:
    """What each horizon after a trade says: the last mid of the market then, or why there is none (yet)."""
    depth = domain(spark, sf_dir, "depth").where("mid_cents IS NOT NULL")
    fills = domain(spark, sf_dir, "wallet_trades").select(F.col("trade_id").alias("fill_id"), F.pmod("trade_id", F.lit(40)).alias("market_id"), "at_us")
    due = fills.select("fill_id", "market_id", "at_us", F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(us).alias("after")) for n, us in HORIZONS.items()))).alias("h"))
    due = due.select("fill_id", "market_id", F.col("h.horizon").alias("horizon"), (F.col("at_us") + F.col("h.after")).alias("due_us"))
    seen = asof_last(due.where(F.col("due_us") <= now_us), depth, "market_id", "due_us", "observed_us", "mid_cents", refs.UNITS["d"], "mid", "depth_id")
    late = due.where(F.col("due_us") > now_us).select("fill_id", "horizon", F.lit(None).cast("double").alias("mid"), F.lit("too_young").alias("state"))
    return seen.select("fill_id", "horizon", "mid", F.when(F.col("mid").isNull(), "depth_missing").otherwise("present").alias("state")).unionByName(late)


POST_FILL = f"""WITH h AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {us})" for n, us in HORIZONS.items())}) AS v(horizon, after)),
d AS (SELECT t.trade_id AS fill_id, t.trade_id % 40 AS market_id, h.horizon, t.at_us + h.after AS due_us FROM wallet_trades t CROSS JOIN h),
m AS (SELECT market_id, observed_us, arg_max(mid_cents, depth_id) AS mid FROM depth WHERE mid_cents IS NOT NULL GROUP BY 1, 2)
SELECT d.fill_id, d.horizon, CASE WHEN d.due_us <= {NOW_US} THEN m.mid END AS mid, CASE WHEN d.due_us > {NOW_US} THEN 'too_young' WHEN m.mid IS NULL THEN 'depth_missing' ELSE 'present' END AS state
FROM d ASOF LEFT JOIN m ON m.market_id = d.market_id AND m.observed_us <= d.due_us"""


def sampled_mids(spark: SparkSession, sf_dir: str, *, step_us: int = refs.UNITS["d"]) -> DataFrame:
    """The mid of each market at every step from its first to its last reading, the last known carried forward."""
    depth = domain(spark, sf_dir, "depth").where("mid_cents IS NOT NULL")
    spans = depth.groupBy("market_id").agg(F.ceil(F.min("observed_us") / step_us).alias("a"), F.floor(F.max("observed_us") / step_us).alias("b")).where("a <= b")
    grid = spans.select("market_id", F.explode(F.sequence("a", "b")).alias("at")).select("market_id", (F.col("at") * step_us).alias("at_us"))
    return asof_last(grid, depth, "market_id", "at_us", "observed_us", "mid_cents", 8 * step_us, "mid", "depth_id")


SAMPLED = f"""WITH d AS (SELECT market_id, observed_us, arg_max(mid_cents, depth_id) AS mid FROM depth WHERE mid_cents IS NOT NULL GROUP BY 1, 2),
s AS (SELECT market_id, ceil(min(observed_us) / {refs.UNITS["d"]})::BIGINT AS a, floor(max(observed_us) / {refs.UNITS["d"]})::BIGINT AS b FROM d GROUP BY 1),
g AS (SELECT market_id, unnest(generate_series(a, b)) * {refs.UNITS["d"]} AS at_us FROM s)
SELECT g.market_id, g.at_us, d.mid FROM g ASOF LEFT JOIN d ON d.market_id = g.market_id AND d.observed_us <= g.at_us"""


def array_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sports that come as two parallel arrays, for a venue each: only rows that they change."""
    m = domain(spark, sf_dir, "markets").select("market_id", "provider_id", "sport")
    sent = m.where("market_id % 3 = 0").groupBy("provider_id").agg(F.collect_list(F.struct("market_id", F.when(F.col("market_id") % 2 == 0, "nfl").otherwise("golf").alias("sport"))).alias("x"))
    sent = sent.select(F.col("x.market_id").alias("ids"), F.col("x.sport").alias("sports"))
    new = sent.select(F.explode(F.arrays_zip("ids", "sports")).alias("z")).select(F.col("z.ids").alias("market_id"), F.col("z.sports").alias("new"))
    return m.join(new, "market_id").where(~F.col("sport").eqNullSafe(F.col("new"))).select("market_id", F.col("sport").alias("old"), "new")


ARRAY_UPDATE = """WITH n AS (SELECT market_id, sport AS old, CASE WHEN market_id % 2 = 0 THEN 'nfl' ELSE 'golf' END AS new FROM markets WHERE market_id % 3 = 0)
SELECT market_id, old, new FROM n WHERE old IS DISTINCT FROM new"""


def closing_trades(spark: SparkSession, sf_dir: str, *, alarm: float = -10.0) -> DataFrame:
    """Fills that close a position, their profit for each contract, and whether that is an alarm."""
    f = domain(spark, sf_dir, "mm_fills").select("market_id", "observed_us", "fill_id", money.yes_delta(F.col("side"), F.col("size")).alias("delta"), F.col("price_cents").cast("double").alias("price"))
    before = Window.partitionBy("market_id").orderBy("observed_us", "fill_id")
    after = positions(f).select("market_id", "fill_id", F.lag("net").over(before).alias("net"), F.lag("cost").over(before).alias("cost"))
    found = f.join(after, ["market_id", "fill_id"]).withColumn("pnl", F.round(instruments.closing_pnl(F.col("net"), F.col("cost"), F.col("delta"), F.col("price")), 6))
    return found.where("pnl IS NOT NULL").select("market_id", "fill_id", "pnl", (F.col("pnl") <= alarm).alias("alarm"))


_WORDS = "list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: len(w) > 1)"
TITLES = f"""WITH t AS (SELECT market_id, provider_id, concat_ws('|', event_ref, category) AS bucket, {_WORDS.format(x="title")} AS w FROM markets),
p AS (SELECT a.bucket, a.market_id AS left_id, b.market_id AS right_id, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(a.w)) + len(list_distinct(b.w)) AS n FROM t a JOIN t b ON a.bucket = b.bucket AND a.provider_id = 1 AND b.provider_id = 2),
s AS (SELECT bucket, left_id, right_id, round(i / (n - i), 6)::DOUBLE AS similarity FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS rn FROM s WHERE similarity >= {refs.LEAST_TITLE_SIMILARITY}),
c AS (SELECT *, round(least(greatest(0.42 + 0.55 * similarity, 0.5), 0.85), 6)::DOUBLE AS confidence FROM r WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY confidence DESC, left_id) AS n FROM c)
SELECT left_id, right_id, similarity, confidence, bucket FROM k WHERE n <= {PER_BLOCK} ORDER BY confidence DESC, left_id LIMIT {PER_RUN}"""

LINKS_PAGE = f"""SELECT l.link_id, l.family_id, l.market_id, m.title, m.category, l.status, l.created_us FROM links l JOIN markets m ON m.market_id = l.market_id
JOIN families f ON f.family_id = l.family_id JOIN canonical_events e ON e.event_id = f.event_id
WHERE l.status = 'active' AND e.slug = 'event-7' AND l.created_us >= {NOW_US} - 90 * 86400000000 ORDER BY l.created_us DESC, l.link_id DESC LIMIT 20 OFFSET 5"""

QUERIES = {
    "links_page_filtered": (lambda spark, sf_dir: links_page(spark, sf_dir, status="active", slug="event-7", since="90d", limit=20, offset=5), LINKS_PAGE),
    "open_markets": (lambda spark, sf_dir: open_markets(spark, sf_dir, contains="Ring", sport="nfl"), OPEN_MARKETS),
    "proposals_of_titles": (proposals_of_titles, TITLES),
    "strike_pairs": (strike_pairs, STRIKES),
    "dual_listings": (dual_listings, DUAL),
    "post_fill_mids": (post_fill_mids, POST_FILL),
    "sampled_mids": (sampled_mids, SAMPLED),
    "array_update": (array_update, ARRAY_UPDATE),
    "closing_trades": (closing_trades, None),
}
