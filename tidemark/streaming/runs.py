"""Streams run to their end over landed files, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_path
from ..sources.paged import LandedPages
from . import book, sinks, states


#: When a bounded run ends: after all rows.
END = "2200-01-01"


def closed(stream: DataFrame, time: str, **values) -> DataFrame:
    """The stream and one row more, at END and with the values given: it moves the watermark past all others, so that a
    bounded run gives every group that they make. The row itself belongs to a group that stays open."""
    spark = stream.sparkSession
    kinds = {f.name: f.dataType for f in stream.schema}
    row = spark.range(1).select(*(F.lit(END if c == time else values.get(c)).cast(t).alias(c) for c, t in kinds.items()))
    path = shared_path(spark, "closing")
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def to_end(stream: DataFrame) -> DataFrame:
    """What a stream gives until all files that lie there have been read, in append mode: groups that the watermark has
    passed, whose state is dropped then. Batches are written by their number, so one that runs twice counts once."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


def with_timers(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Runs a stream whose states have timers, in a session that may not have their state store yet."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, states.PROVIDER)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table may be one file
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def streamed_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute flow of a market, from a stream of trades."""
    e = _events(spark, sf_dir)
    trades = e.select(F.concat(F.lit("m"), F.col("user_id") % 20).alias("market"), "at", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.round("value", 4).alias("usdc"))
    out = to_end(book.flow(closed(trades, "at")))
    return out.select("market", F.unix_micros("bucket").alias("bucket_us"), "buys", "sells", F.round("usdc", 4).alias("usdc"))


STREAMED_FLOW = "SELECT market, CAST(floor(at_us / 300000000) AS BIGINT) * 300000000 AS bucket_us, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells, round(sum(usdc), 4) AS usdc FROM wallet_trades GROUP BY 1, 2"


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap sessions of executable edges, from a stream of quotes."""
    e = _events(spark, sf_dir)
    quotes = e.select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("candidate"), F.col("event_type").alias("event_id"), F.col("at").alias("observed_at"),
        F.when(F.col("event_id") % 11 != 0, F.round((F.col("value") % 100) / 100, 4)).alias("bid_1"), F.round(((F.col("value") * 7) % 100) / 100, 4).alias("ask_2"),
    )
    out = to_end(book.gap_sessions(closed(quotes, "observed_at", bid_1=1.0, ask_2=0.0), "1800 seconds"))
    return out.select("candidate", "event_id", F.unix_micros("edge_start").alias("start_us"), F.unix_micros("edge_end").alias("end_us"), "observations", F.round("max_edge", 6).alias("max_edge"))


STREAMED_SESSIONS = """WITH edges AS (SELECT id, candidate, event_id, observed_us, bid_1 - ask_2 AS edge FROM spreads WHERE bid_1 > ask_2),
gaps AS (SELECT *, observed_us - lag(observed_us) OVER (PARTITION BY candidate, event_id ORDER BY observed_us, id) AS gap FROM edges),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY candidate, event_id ORDER BY observed_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM gaps)
SELECT candidate, event_id, min(observed_us) AS start_us, max(observed_us) AS end_us, count(*) AS observations, round(max(edge), 6) AS max_edge FROM runs GROUP BY candidate, event_id, grp"""

def observed(spark: SparkSession, sf_dir: str) -> str:
    """Runs the observer over landed quotes to their end; the folder of its tables. Every quote comes twice."""
    e = _events(spark, sf_dir)
    quotes = e.select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("pair"), F.col("event_id"), F.col("at").alias("observed_at"),
        F.when(F.col("event_id") % 11 != 0, F.round((F.col("value") % 100) / 100, 4)).alias("price_1"), F.when(F.col("event_id") % 13 != 0, F.round(((F.col("value") * 7) % 100) / 100, 4)).alias("price_2"),
        (F.col("event_id") % 17 != 0).alias("parsed"),
    )
    path = shared_path(spark, "observer")
    sinks.observer(quotes.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), path, 3).awaitTermination()
    return path


def observed_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spreads that the observer writes."""
    rows = sinks.committed(spark, observed(spark, sf_dir), "spreads", sinks.HEARTBEAT)
    return rows.select("pair", "event_id", F.unix_micros("observed_at").alias("observed_us"), F.round("spread", 4).alias("spread"))


def observed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the observer's heartbeats and snapshots say in all."""
    path = observed(spark, sf_dir)
    beats = sinks.committed(spark, path, sinks.HEARTBEAT, sinks.HEARTBEAT)
    beats = beats.agg(*(F.sum(c).alias(c) for c in ("attempted", "succeeded", "errors_1", "errors_2", "parse_errors")))
    snapshots = sinks.committed(spark, path, "snapshots", sinks.HEARTBEAT).agg(F.count(F.lit(1)).alias("snapshots"), F.round(F.sum("price_yes"), 3).alias("prices"))
    return beats.crossJoin(F.broadcast(snapshots))  # one row each


_QUOTED = """WITH q AS (SELECT concat('c', user_id % 3) AS pair, event_id, epoch_us(ts) AS observed_us, CASE WHEN event_id % 11 <> 0 THEN round((value % 100) / 100, 4) END AS a,
CASE WHEN event_id % 13 <> 0 THEN round(((value * 7) % 100) / 100, 4) END AS b, event_id % 17 <> 0 AS parsed FROM events)
"""
OBSERVED_SPREADS = _QUOTED + "SELECT pair, event_id, observed_us, round(a - b, 4) AS spread FROM q WHERE parsed AND a IS NOT NULL AND b IS NOT NULL"
OBSERVED_HEALTH = _QUOTED + """SELECT count(*) AS attempted, count(*) FILTER (WHERE parsed AND a IS NOT NULL AND b IS NOT NULL) AS succeeded, count(*) FILTER (WHERE parsed AND a IS NULL) AS errors_1,
count(*) FILTER (WHERE parsed AND b IS NULL) AS errors_2, count(*) FILTER (WHERE NOT parsed) AS parse_errors, count(a) FILTER (WHERE parsed) + count(b) FILTER (WHERE parsed) AS snapshots,
round(sum(coalesce(a, 0) + coalesce(b, 0)) FILTER (WHERE parsed), 3) AS prices FROM q"""


def settled_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each market was settled last, and how often its settlement was observed: both outputs of one run."""
    e = _events(spark, sf_dir)
    seen = e.where("event_type = 'purchase'").select(F.col("user_id").alias("market_id"), (1 + F.col("user_id") % 2).cast("int").alias("provider_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "no").otherwise("yes").alias("outcome"), F.unix_micros("at").alias("resolved_us"))
    path = shared_path(spark, "settlements")
    sinks.settlements(seen, path).awaitTermination()
    counts = sinks.settlement_history(spark, path).groupBy("market_id").agg(F.count(F.lit(1)).alias("observed"))
    return sinks.settled(spark, path).join(counts, "market_id", "full_outer").select("market_id", "outcome", "resolved_us", "observed")


SETTLED_MARKETS = "SELECT user_id AS market_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'no' ELSE 'yes' END, event_id) AS outcome, arg_max(epoch_us(ts), event_id) AS resolved_us, count(*) AS observed FROM events WHERE event_type = 'purchase' GROUP BY 1"
#: A day, at which books of the test tables are sampled; hours in which so many failures are a burst.
DAY_MS, HOURS_MS, SOME = 86_400_000, 72 * 3_600_000, 3


def streamed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of each ticker at the start of every day, from a stream of snapshots and deltas over two connections."""
    e = _events(spark, sf_dir)
    level = lambda p: F.array(F.struct(p.cast("string").alias("price"), F.lit(5.0).alias("qty")))
    price = lambda k: F.round((F.col("event_id") * k % 40 + 5) / 100, 2)
    messages = e.select(
        F.concat(F.lit("t"), F.col("user_id") % 50).alias("ticker"), "at", F.col("event_id").alias("seq"), (F.col("at") >= "2024-01-16").cast("int").alias("epoch"),
        F.when(F.col("event_id") % 4 == 0, "snapshot").otherwise("delta").alias("kind"), level(price(3)).alias("yes"), F.when(F.col("event_id") % 3 > 0, level(price(7))).alias("no"),
    )
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp").alias("x")).first()[0]  # one time
    closing = f"{ends:%Y-%m-%d}"
    return with_timers(spark, lambda: to_end(states.sampled_books(closed_at(messages, "at", closing), DAY_MS))).drop("yes_levels")


def closed_at(stream: DataFrame, time: str, day: str) -> DataFrame:
    """As closed, with a row of no ticker at a day's start: for streams that give rows as long as time passes."""
    spark = stream.sparkSession
    path = shared_path(spark, "closing")
    spark.range(1).select(*((F.lit(day).cast("timestamp") + F.expr("INTERVAL 1 DAY 10 SECONDS") if f.name == time else F.lit("delta" if f.name == "kind" else None).cast(f.dataType)).alias(f.name) for f in stream.schema)).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def streamed_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When tickers are left alone after a burst of failures, and when no more."""
    e = _events(spark, sf_dir)
    placed = e.select(F.concat(F.lit("t"), F.col("user_id") % 50).alias("ticker"), "at", F.col("event_id").alias("seq"), (F.col("event_id") % 7 == 0).alias("ok"))
    return with_timers(spark, lambda: to_end(states.burst_changes(closed(placed, "at", ok=True), HOURS_MS, SOME)))


STREAMED_SAMPLES = f"""WITH m AS (SELECT concat('t', user_id % 50) AS ticker, epoch_us(ts) // 1000 AS ms, event_id AS seq, ts >= TIMESTAMP '2024-01-16' AS epoch, event_id % 4 = 0 AS snap,
  CAST(event_id * 3 % 40 + 5 AS INT) AS y, CASE WHEN event_id % 3 > 0 THEN CAST(event_id * 7 % 40 + 5 AS INT) END AS n FROM events),
d AS (SELECT unnest(generate_series((SELECT min(ms) // {DAY_MS} FROM m), (SELECT max(ms) // {DAY_MS} FROM m) + 1)) * {DAY_MS} AS at_ms),
l AS (SELECT ticker, at_ms, max(ms) AS seen, arg_max(epoch, ms * 1000000 + seq) AS epoch FROM d JOIN m ON ms <= at_ms GROUP BY 1, 2),
s AS (SELECT l.ticker, at_ms, seen, l.epoch, max(ms * 1000000 + seq) AS since FROM l JOIN m ON m.ticker = l.ticker AND m.epoch = l.epoch AND snap AND ms <= at_ms GROUP BY 1, 2, 3, 4),
b AS (SELECT s.ticker, at_ms, seen, max(y) AS y, max(n) AS n FROM s JOIN m ON m.ticker = s.ticker AND m.epoch = s.epoch AND ms <= at_ms AND ms * 1000000 + seq >= since GROUP BY 1, 2, 3)
SELECT ticker, at_ms, CASE WHEN 100 - n >= y THEN (y + 100 - n) / 2 END::DOUBLE AS mid_cents, CASE WHEN 100 - n >= y THEN 100 - n - y END AS spread_cents, at_ms - seen AS age_ms FROM b"""

def paged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page of a collector holds, from a stream over the pages that it has landed."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = shared_path(spark, "pages")
    pages = rows.select(F.floor(F.col("event_id") / 1000).alias("page"), F.to_json(F.struct("event_id", "event_type")).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    spark.dataSource.register(LandedPages)
    out = to_end(spark.readStream.format("landed_pages").load(path))
    read = out.select("page", F.from_json("body", "event_id long, event_type string").alias("r"))
    return read.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("r.event_id").alias("ids"), F.count_if(F.col("r.event_type") == "click").alias("clicks"))


PAGED_EVENTS = "SELECT event_id // 1000 AS page, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1"

QUERIES = {
    "paged_events": (paged_events, PAGED_EVENTS),
    "streamed_flow": (streamed_flow, STREAMED_FLOW), "streamed_sessions": (streamed_sessions, STREAMED_SESSIONS), "observed_spreads": (observed_spreads, OBSERVED_SPREADS), "observed_health": (observed_health, OBSERVED_HEALTH),
    "settled_markets": (settled_markets, SETTLED_MARKETS), "streamed_samples": (streamed_samples, STREAMED_SAMPLES), "streamed_bursts": (streamed_bursts, None),
}
