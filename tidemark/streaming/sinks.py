"""Sinks that a replayed micro-batch leaves as they were, and the observer that writes through one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HEARTBEAT = "heartbeats"


def into_tables(stream: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]], last: str, **trigger) -> StreamingQuery:
    """Writes each batch to several tables, `last` the last of them, each into a folder named by the batch's number. A batch
    that failed midway runs again under its number and overwrites what it had written. `last` has rows only of batches
    that are whole, which is what `committed` reads by."""
    order = [*(t for t in tables if t != last), last]

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name in order:
                tables[name](batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, path: str, name: str, last: str) -> DataFrame:
    """The rows of a table from whole batches, with the batch's number."""
    whole = spark.read.parquet(f"{path}/{last}").select("batch").distinct()  # a number for each batch
    return spark.read.parquet(f"{path}/{name}").join(whole, "batch", "left_semi")


def observer(quotes: DataFrame, path: str, configured: int, watermark: str = "10 minutes", **trigger) -> StreamingQuery:
    """An observer's cycle as a micro-batch: spreads of pairs that both venues priced, a snapshot of each priced listing and
    one heartbeat with what went wrong. A quote that comes twice within the watermark is one.

    quotes: pair, event_id, observed_at, price_1, price_2 (null where a venue could not be read), parsed (whether its message
    could be)."""
    once = quotes.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["pair", "event_id", "observed_at"])
    priced = F.col("parsed") & F.col("price_1").isNotNull() & F.col("price_2").isNotNull()

    def spreads(b: DataFrame) -> DataFrame:
        return b.where(priced).select("pair", "event_id", "observed_at", "price_1", "price_2", (F.col("price_1") - F.col("price_2")).alias("spread"))

    def snapshots(b: DataFrame) -> DataFrame:
        sides = F.explode(F.array(*(F.struct(F.lit(v).alias("venue"), F.col(f"price_{v}").alias("price_yes")) for v in (1, 2))))
        return b.where("parsed").select("pair", "event_id", "observed_at", sides.alias("s")).select("pair", "event_id", "observed_at", "s.*").where("price_yes IS NOT NULL")

    def heartbeat(b: DataFrame) -> DataFrame:
        failed = lambda c: F.count_if(c)
        return b.agg(
            F.max("observed_at").alias("cycle_at"), F.count(F.lit(1)).alias("attempted"), failed(priced).alias("succeeded"), F.lit(configured).alias("configured"),
            failed(F.col("parsed") & F.col("price_1").isNull()).alias("errors_1"), failed(F.col("parsed") & F.col("price_2").isNull()).alias("errors_2"), failed(~F.col("parsed")).alias("parse_errors"),
        )

    return into_tables(once, path, {"spreads": spreads, "snapshots": snapshots, HEARTBEAT: heartbeat}, HEARTBEAT, **trigger)


HISTORY, CHANGES = "history", "changes"


def settlements(stream: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Keeps every settlement that is observed, and how each market stands after it, by one run: a batch's history and the
    last of it for each market are written under its number.

    stream: market_id, provider_id, seq (in which order they were observed), outcome, resolved_us, and more."""

    def changes(batch: DataFrame) -> DataFrame:
        others = [c for c in batch.columns if c != "market_id"]
        return batch.groupBy("market_id").agg(F.max_by(F.struct(*others), "seq").alias("r")).select("market_id", "r.*")

    return into_tables(stream, path, {HISTORY: lambda b: b, CHANGES: changes}, CHANGES, **trigger)


def settlement_history(spark: SparkSession, path: str) -> DataFrame:
    return committed(spark, path, HISTORY, CHANGES)


def settled(spark: SparkSession, path: str) -> DataFrame:
    """How each market stands: its newest change, by batch. Changes are few beside the history, and old ones can be merged
    away by writing this down as a batch."""
    rows = spark.read.parquet(f"{path}/{CHANGES}")
    others = [c for c in rows.columns if c not in ("market_id", "batch")]
    return rows.groupBy("market_id").agg(F.max_by(F.struct(*others), "batch").alias("r")).select("market_id", "r.*")
