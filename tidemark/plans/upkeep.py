"""Classification, upkeep and health queries built from the column expressions, each with SQL written by itself.

The test tables hold no listings' titles of these kinds. Titles are composed from the phrases below, one for each market,
whose templates are known; so the SQL states what each phrase is, by no pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listings, quoting, templates
from ..operators.distinct import once_each
from ..operators.folds import ordered_fold
from .domain import domain

NOW_US, HOUR_US = 1_705_000_000_000_000, 3_600_000_000
COOLDOWN_US = HOUR_US // 2
#: category, phrase ({} a number from 1 to 9, [] a day of June 2026), its template, its asset, whether it has a strike, what
#: it has a date as.
PHRASES = (
    ("crypto", "Bitcoin above ${}K on 2026-06-[]", "btc-price-threshold", "btc", True, "day"),
    ("crypto", "Will BTC dip to ${}K on June [], 2026?", "btc-price-dip", "btc", True, "day"),
    ("crypto", "Will Ethereum hit ${}K by 6/[]/2026?", "eth-milestone", "eth", True, "day"),
    ("crypto", "Solana up or down on 2026-06-[]", "sol-daily-direction", "sol", False, "day"),
    ("crypto", "Bitcoin price range on 2026-06-[]", "btc-daily-range", "btc", False, "day"),
    ("crypto", "Bitcoin up or down - {}:05 ET", "btc-interval", "btc", False, None),
    ("crypto", "MicroStrategy buys bitcoin", "crypto-corporate", "btc", False, None),
    ("economics", "Fed decision on June [], 2026: hold", "fed-rate-decision", None, False, "meeting"),
    ("economics", "Raise of rates after 2026-06-[]", "fed-rate-direction", None, False, "meeting"),
    ("economics", "CPI above {}% 2026-06-[]", "cpi-threshold", None, False, "meeting"),
    ("economics", "Powell to leave as chair", "fed-personnel", None, False, None),
    ("economics", "Will it rain?", None, None, False, None),
    ("sports", "Ducks at Kings winner?", "sports-moneyline", None, False, None),
    ("sports", "Ducks at Kings: both teams to score", "sports-yes-no", None, False, None),
)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_id, provider_id, event_ref, category and composed title of each market."""
    m = domain(spark, sf_dir, "markets")
    pick = F.element_at(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase")) for c, p, *_ in PHRASES)), (F.pmod("market_id", F.lit(len(PHRASES))) + 1).cast("int"))
    number, day = F.pmod(F.floor(F.col("market_id") / 20), F.lit(9)) + 1, F.lpad((F.pmod(F.floor(F.col("market_id") / 40), F.lit(28)) + 1).cast("string"), 2, "0")
    title = F.replace(F.replace(pick["phrase"], F.lit("{}"), number.cast("string")), F.lit("[]"), day)
    return m.select("market_id", "provider_id", "event_ref", "size", pick["category"].alias("category"), title.alias("title"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings with their template t, which is found once for each different title of a category."""
    return once_each(listed(spark, sf_dir), ["category", "title"], lambda named: named.withColumn("t", templates.template(F.col("category"), F.col("title"), F.lit(""))))


_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
KNOWN = f"""p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_TEXT(t)}, {_TEXT(a)}, {s}, {_TEXT(d)})" for i, (_, _, t, a, s, d) in enumerate(PHRASES))}) AS v(i, template, asset, struck, dated)),
k AS (SELECT market_id, provider_id, event_ref, size, p.template, asset, CASE WHEN struck THEN 1000.0 * (floor(market_id / 20)::BIGINT % 9 + 1) END::DOUBLE AS strike,
  CASE WHEN dated IS NOT NULL THEN floor(market_id / 40)::BIGINT % 28 + 1 END AS june, dated FROM markets JOIN p ON i = market_id % {len(PHRASES)})"""


def template_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing asks; listings that no rule fits fall out."""
    return _classified(spark, sf_dir).where("t IS NOT NULL").select("market_id", "t.template", "t.asset", "t.strike", "t.day", "t.meeting")


KINDS = f"""WITH {KNOWN} SELECT market_id, template, asset, strike, CASE WHEN dated = 'day' THEN printf('2026-06-%02d', june) END AS day,
CASE WHEN dated = 'meeting' THEN printf('2026-06-%02d', june) END AS meeting FROM k WHERE template IS NOT NULL"""


def template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the two venues on one event and of one size, with whether their templates can ask the same, and why."""
    t = _classified(spark, sf_dir)
    a = t.where("provider_id = 1").select("event_ref", "size", F.col("market_id").alias("left_id"), F.col("t").alias("a"))
    b = t.where("provider_id = 2").select("event_ref", "size", F.col("market_id").alias("right_id"), F.col("t").alias("b"))
    pairs = a.join(b, ["event_ref", "size"]).withColumn("f", templates.same_question(F.col("a"), F.col("b")))
    return pairs.select("left_id", "right_id", "f.compatible", "f.reason")


PAIRS = f"""WITH {KNOWN}, q AS (SELECT a.market_id AS left_id, b.market_id AS right_id, regexp_replace(a.template, '^(btc|eth|sol)-', '') AS x, regexp_replace(b.template, '^(btc|eth|sol)-', '') AS y,
  a.asset = b.asset OR a.asset IS NULL OR b.asset IS NULL AS assets, abs(a.strike - b.strike) <= 0.1 * greatest(a.strike, b.strike) AS strikes, abs(a.june - b.june) <= 1 AS days
  FROM k a JOIN k b ON a.event_ref = b.event_ref AND a.size = b.size AND a.provider_id = 1 AND b.provider_id = 2),
r AS (SELECT left_id, right_id, CASE WHEN x IS NULL OR y IS NULL THEN 'missing_template' WHEN 'interval' IN (x, y) THEN 'interval_isolated'
  WHEN (x = 'crypto-corporate') <> (y = 'crypto-corporate') THEN 'corporate_vs_asset' WHEN (x = 'milestone' AND y LIKE 'daily%') OR (y = 'milestone' AND x LIKE 'daily%') THEN 'milestone_vs_daily'
  WHEN (x = 'fed-personnel') <> (y = 'fed-personnel') AND (x LIKE 'fed-rate%' OR y LIKE 'fed-rate%') THEN 'personnel_vs_rates'
  WHEN x = y AND x = 'fed-personnel' THEN 'fed_special' WHEN x = y AND x LIKE 'fed-rate%' THEN CASE WHEN days THEN 'fed_meeting' ELSE 'fed_meeting_mismatch' END
  WHEN x = y AND x = 'milestone' THEN CASE WHEN strikes AND assets THEN 'milestone' ELSE 'milestone_params' END
  WHEN x = y AND x LIKE 'sports%' THEN 'same_template' WHEN x = y AND x = 'cpi-threshold' THEN CASE WHEN days THEN 'econ' ELSE 'econ_params' END
  WHEN x = y AND x = 'crypto-corporate' THEN 'same_template_default'
  WHEN x LIKE 'price-%' AND y LIKE 'price-%' THEN CASE WHEN NOT assets THEN 'asset_mismatch' WHEN NOT strikes THEN 'strike_mismatch' WHEN NOT days THEN 'date_mismatch' WHEN x = y THEN 'threshold' ELSE 'threshold_dip' END
  WHEN x LIKE 'daily-%' AND y LIKE 'daily-%' THEN CASE WHEN NOT assets THEN 'asset_mismatch' WHEN NOT days THEN 'date_mismatch' WHEN x = y THEN 'daily' ELSE 'daily_range_direction' END
  WHEN x LIKE 'fed-rate%' AND y LIKE 'fed-rate%' THEN CASE WHEN days THEN 'fed_decision_direction' ELSE 'fed_meeting_mismatch' END ELSE 'no_rule' END AS reason FROM q)
SELECT left_id, right_id, reason IN ('fed_special', 'fed_meeting', 'milestone', 'same_template', 'econ', 'same_template_default', 'threshold', 'threshold_dip', 'daily', 'daily_range_direction', 'fed_decision_direction') AS compatible, reason FROM r"""

#: event reference, title, and their phase, subject, office and key without the year.
RACES = (
    ("GOVPARTYOH-2026", "Ohio governor general election", "general", "candidate", "governor", "gov_ohio"),
    ("SEN-X", "Maine Senate primary 2026", "primary", "candidate", "senate", "senate_maine"),
    ("PRES-PRI-2028", "Presidential race", "primary", "candidate", "president", "president_us"),
    ("HOUSE-tx", "House race runoff", "runoff", "candidate", "house", "house_texas"),
    ("BILL-9", "Special tax bill passes", "special", "policy", "other_politics", "other_politics_bill_9"),
)


def politics_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings and events by venue and by what election they are of."""
    m = domain(spark, sf_dir, "markets").where("status IN ('open', 'active')")
    pick = F.element_at(F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(t).alias("title")) for r, t, *_ in RACES)), (F.pmod(F.floor(F.col("market_id") / 7), F.lit(len(RACES))) + 1).cast("int"))
    e = templates.election(pick["ref"], pick["title"])
    rows = m.select("provider_id", "event_ref", e.alias("e")).groupBy("provider_id", "e.phase", "e.subject", "e.office", "e.event_key")
    return rows.agg(F.countDistinct("event_ref").alias("events"), F.count(F.lit(1)).alias("markets"))


HEALTH = f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{ph}', '{su}', '{of}', '{key}_{2028 if of == 'president' else 2026}')" for i, (_, _, ph, su, of, key) in enumerate(RACES))}) AS v(i, phase, subject, office, event_key))
SELECT provider_id, phase, subject, office, event_key, count(DISTINCT event_ref) AS events, count(*) AS markets FROM markets JOIN p ON i = floor(market_id / 7)::BIGINT % {len(RACES)}
WHERE status IN ('open', 'active') GROUP BY ALL"""


def _cooled(state: dict, row: dict) -> dict:
    fires = state["last"] is None or row["at_us"] - state["last"] >= COOLDOWN_US
    return {"last": row["at_us"] if fires else state["last"], "fires": fires}


def fired_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the failed requests of a path those that sound an alert: none within half an hour of the last that did."""
    failed = domain(spark, sf_dir, "requests").where("status = 500").groupBy("path", "at_us").agg(F.count(F.lit(1)).alias("n"))
    state = ordered_fold(failed.select("path", "at_us"), "path", ["at_us"], lambda: {"last": None, "fires": False}, _cooled, "last long, fires boolean")
    return state.where("fires").select("path", "at_us")


FIRED = f"""SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT path, at_us FROM requests WHERE status = 500),
r AS (SELECT path, min(at_us) AS at_us FROM f GROUP BY path
  UNION ALL SELECT r.path, (SELECT min(f.at_us) FROM f WHERE f.path = r.path AND f.at_us >= r.at_us + {COOLDOWN_US}) AS at_us FROM r WHERE r.at_us IS NOT NULL)
SELECT path, at_us FROM r WHERE at_us IS NOT NULL)"""


def reaped_payloads(spark: SparkSession, sf_dir: str, *, stale_us: int = 300_000_000) -> DataFrame:
    """Open orders without an exchange's id that are stale become errors; reason and bound are merged into their payload, new
    keys over old ones."""
    o = domain(spark, sf_dir, "mm_orders").where(f"status = 'open' AND exchange_id IS NULL AND placed_us < {NOW_US} - {stale_us}")
    old = F.from_json(F.when(F.col("order_id") % 3 != 0, F.concat(F.lit('{"reason":"old","price":"'), F.col("price_cents"), F.lit('"}'))), "map<string,string>")
    new = F.create_map(F.lit("reason"), F.lit("stale_pending"), F.lit("after_s"), F.lit(str(stale_us // 1_000_000)))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return o.select("order_id", F.lit("errored").alias("status"), F.to_json(F.map_concat(kept, new)).alias("payload"))


REAPED = f"""SELECT order_id, 'errored' AS status, CAST(CASE WHEN order_id % 3 <> 0 THEN json_object('price', price_cents::VARCHAR, 'reason', 'stale_pending', 'after_s', '300')
ELSE json_object('reason', 'stale_pending', 'after_s', '300') END AS VARCHAR) AS payload FROM mm_orders WHERE status = 'open' AND exchange_id IS NULL AND placed_us < {NOW_US - 300_000_000}"""


def reason_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often rejected proposals' reasons (JSON) hold each key."""
    p = domain(spark, sf_dir, "proposals").where("decision = 'rejected'")
    reasons = F.concat(F.lit('{"'), F.col("reason"), F.lit('":1'), F.when(F.col("proposal_id") % 3 == 0, ',"skip_reason":"x"').otherwise(""), F.lit("}"))
    return p.select(F.explode(F.json_object_keys(reasons)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("cnt"))


KEYS = """SELECT k, count(*) AS cnt FROM (SELECT reason AS k FROM proposals WHERE decision = 'rejected' UNION ALL SELECT 'skip_reason' FROM proposals WHERE decision = 'rejected' AND proposal_id % 3 = 0)
WHERE k IS NOT NULL GROUP BY k"""


def revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected proposals whose listings can be of one game after all, by the rules for pairs of games."""
    m = domain(spark, sf_dir, "markets")
    side = lambda s: m.select(F.col("market_id").alias(f"market_{s}"), F.col("sport").alias(f"sport_{s}"), F.col("game_day").alias(f"day_{s}"), listings.matchup_key(F.split_part("title", F.lit(" "), F.lit(1)), F.lit("Kings")).alias(f"key_{s}"))
    pairs = domain(spark, sf_dir, "proposals").where("decision = 'rejected'").join(side("a"), "market_a").join(side("b"), "market_b")
    days = F.abs(F.col("day_a") - F.col("day_b"))
    fault = listings.sports_pair_fault(F.col("sport_a"), F.col("sport_b"), days, F.col("key_a"), F.col("key_b"))
    return pairs.select("proposal_id", F.coalesce(F.when(days.isNull(), "no_date"), fault, F.lit("valid")).alias("verdict"))


REVALIDATED = """SELECT proposal_id, CASE WHEN a.game_day IS NULL OR b.game_day IS NULL THEN 'no_date' WHEN coalesce(a.sport, 'unknown') = 'unknown' OR coalesce(b.sport, 'unknown') = 'unknown' THEN 'sport_unknown'
WHEN a.sport <> b.sport THEN 'sport_mismatch' WHEN abs(a.game_day - b.game_day) > 1 THEN 'game_date_delta_gt_1' WHEN split_part(a.title, ' ', 1) <> split_part(b.title, ' ', 1) THEN 'matchup_mismatch' ELSE 'valid' END AS verdict
FROM proposals JOIN markets a ON a.market_id = market_a JOIN markets b ON b.market_id = market_b WHERE decision = 'rejected'"""


def reslotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What slots would become if their legs were grouped anew by event, kind and title: counts by template."""
    legs = domain(spark, sf_dir, "slots").join(domain(spark, sf_dir, "markets").select("market_id", "event_ref"), "market_id")
    groups = legs.groupBy("slot_id", "event_ref", "template", "title").agg(F.count_if(F.col("provider_id") == 1).alias("a"), F.count_if(F.col("provider_id") == 2).alias("b"))
    ready, over = (F.col("a") == 1) & (F.col("b") == 1), (F.col("a") > 1) | (F.col("b") > 1)
    return groups.groupBy(F.coalesce("template", F.lit("(null)")).alias("template")).agg(
        F.count(F.lit(1)).alias("slots"), F.sum(F.col("a") + F.col("b")).alias("legs"), F.count_if(ready).alias("bilateral"), F.count_if(over).alias("overfilled"), F.count_if(~ready & ~over).alias("solo")
    )


RESLOTTED = """WITH g AS (SELECT s.slot_id, m.event_ref, s.template, s.title, list(s.provider_id) AS legs FROM slots s JOIN markets m USING (market_id) GROUP BY ALL),
n AS (SELECT coalesce(template, '(null)') AS template, len(legs) AS legs, len(list_filter(legs, lambda x: x = 1)) AS a, len(list_filter(legs, lambda x: x = 2)) AS b FROM g)
SELECT template, count(*) AS slots, sum(legs)::BIGINT AS legs, sum((a = 1 AND b = 1)::INT)::BIGINT AS bilateral, sum((a > 1 OR b > 1)::INT)::BIGINT AS overfilled, sum((a + b = 1)::INT)::BIGINT AS solo FROM n GROUP BY template"""


def rotation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why listings are not quoted; those that can be are 'ok'."""
    m = domain(spark, sf_dir, "markets")
    i = F.col("market_id")
    ticker = F.concat(F.when(i % 13 == 0, "KXMVE").otherwise("KXA"), F.when(i % 11 == 0, "-B5").otherwise("-T5"))
    bid, ask = (F.pmod(i * 7, F.lit(100))) / 100, (F.pmod(i * 7 + i % 4, F.lit(100))) / 100
    hours = lambda us: (us - NOW_US) / HOUR_US
    fault = quoting.rotation_fault(ticker, i % 17 == 0, bid, ask, hours(F.col("close_us")), i % 15, i % 300, F.when(i % 9 == 0, i % 10))
    return m.select("market_id", F.coalesce(fault, F.lit("ok")).alias("verdict"))


ROTATION = f"""WITH q AS (SELECT market_id AS i, (market_id * 7) % 100 AS bid, (market_id * 7 + market_id % 4) % 100 AS ask, close_us FROM markets)
SELECT i AS market_id, CASE WHEN i % 17 = 0 THEN 'blocklist' WHEN i % 13 = 0 OR i % 11 = 0 OR bid <= 1 OR ask <= bid OR ask >= 99 OR close_us < {NOW_US + 4 * HOUR_US} THEN 'not_a_candidate'
WHEN ask - bid <= 1 AND i % 300 < 100 THEN 'locked_and_thin' WHEN i % 15 > 12 THEN 'pre_event_dead_air' WHEN i % 9 = 0 AND i % 10 > 4 THEN 'game_already_ended' ELSE 'ok' END AS verdict FROM q"""


def schedule_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last written state of each event of a schedule that is read again and again."""
    s = domain(spark, sf_dir, "spreads")
    return s.groupBy("event_id", "candidate").agg(F.max_by(F.struct("id", "bid_1"), F.struct("observed_us", "id")).alias("x")).select("event_id", "candidate", "x.id", "x.bid_1")


SCHEDULE = "SELECT event_id, candidate, id, bid_1 FROM spreads QUALIFY row_number() OVER (PARTITION BY event_id, candidate ORDER BY observed_us DESC, id DESC) = 1"

QUERIES = {
    "template_kinds": (template_kinds, KINDS),
    "template_pairs": (template_pairs, PAIRS),
    "politics_health": (politics_health, HEALTH),
    "fired_alerts": (fired_alerts, FIRED),
    "reaped_payloads": (reaped_payloads, REAPED),
    "reason_keys": (reason_keys, KEYS),
    "revalidated": (revalidated, REVALIDATED),
    "reslotted": (reslotted, RESLOTTED),
    "rotation_faults": (rotation_faults, ROTATION),
    "schedule_latest": (schedule_latest, SCHEDULE),
}
