"""Order books, sessions and block forks, each in batch; the streams run the same functions on micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVELS = 10
ROW = "ticker string, seq long, mid_cents double, spread_cents int, yes_levels array<struct<price:int,qty:double>>, no_levels array<struct<price:int,qty:double>>"


def cents(price: object, qty: object) -> tuple[int, float | None] | None:
    """A level's price in cents; text and fractions up to 1 are dollars. None where it can't be one."""
    try:
        p, q = float(price), None if qty is None else float(qty)
    except (TypeError, ValueError):
        return None
    dollars = isinstance(price, str) or (0 < p <= 1 and p != int(p))
    c = int(p * 100 + 0.5) if dollars else int(p + 0.5)
    return (c, q) if 0 <= c <= 100 else None


def apply_message(book: dict[str, dict[int, float]], kind: str, sides: dict[str, list | None]) -> dict[str, dict[int, float]]:
    """A snapshot replaces both ladders, a delta sets levels or removes them (no quantity); a missing side stays."""
    out = {side: ({} if kind == "snapshot" else dict(book.get(side, {}))) for side in ("yes", "no")}
    for side, levels in sides.items():
        for price, qty in levels or []:
            if (level := cents(price, qty)) is None:
                continue
            if not level[1] or level[1] < 0 and kind == "snapshot":
                out[side].pop(level[0], None)
            else:
                out[side][level[0]] = level[1]
    return out


def top(ladder: dict[int, float], k: int = LEVELS) -> list[tuple[int, float]]:
    return sorted(ladder.items(), reverse=True)[:k]


def mid_spread(book: dict[str, dict[int, float]]) -> tuple[float | None, int | None]:
    if not book.get("yes") or not book.get("no"):
        return None, None
    bid, ask = max(book["yes"]), 100 - max(book["no"])
    return ((bid + ask) / 2, ask - bid) if ask >= bid else (None, None)


def replay(messages: DataFrame) -> DataFrame:
    """The book after each message. messages: ticker, seq, kind, yes, no (arrays of price and qty as strings, or null).

    The messages of a ticker stream through one task in order of seq; only its current book is held. What comes before a
    ticker's first snapshot gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book, ready = None, {}, False
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                if r["ticker"] != at:
                    at, book, ready = r["ticker"], {}, False
                book, ready = _step(book, r), ready or r["kind"] == "snapshot"
                if ready:
                    out.append(_row(at, r["seq"], book))
            yield pd.DataFrame(out, columns=["ticker", "seq", "mid_cents", "spread_cents", "yes_levels", "no_levels"])

    return messages.repartition("ticker").sortWithinPartitions("ticker", "seq").mapInPandas(run, ROW)


def _step(book: dict, r: dict) -> dict:
    sides = {s: None if r[s] is None else [(x["price"], x["qty"]) for x in r[s]] for s in ("yes", "no")}
    return apply_message(book, r["kind"], sides)


def _row(ticker: str, seq: int, book: dict) -> list:
    mid, spread = mid_spread(book)
    levels = [[{"price": p, "qty": q} for p, q in top(book.get(s, {}))] for s in ("yes", "no")]
    return [ticker, seq, mid, spread, *levels]


def stream_books(messages: DataFrame) -> DataFrame:
    """The same over a stream, a book for each ticker in the state; rows of a micro-batch in order of seq."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book, ready = {"yes": {}, "no": {}}, False
        if state.exists:
            yes, no, ready = state.get
            book = {"yes": {int(p): q for p, q in yes}, "no": {int(p): q for p, q in no}}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.to_dict("records"):
            book, ready = _step(book, r), ready or r["kind"] == "snapshot"
            if ready:
                out.append(_row(key[0], r["seq"], book)[:4])
        state.update(([(float(p), q) for p, q in book["yes"].items()], [(float(p), q) for p, q in book["no"].items()], ready))
        yield pd.DataFrame(out, columns=["ticker", "seq", "mid_cents", "spread_cents"])

    ladder = "array<struct<p:double,q:double>>"
    return messages.groupBy("ticker").applyInPandasWithState(update, "ticker string, seq long, mid_cents double, spread_cents int", f"yes {ladder}, no {ladder}, ready boolean", "append", GroupStateTimeout.NoTimeout)


def gap_sessions(spreads: DataFrame, gap: str = "90 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Sessions of executable edges: batch or stream. spreads: candidate, event_id, observed_at, bid_1, ask_2."""
    edges = spreads.where("bid_1 > ask_2").withColumn("edge", F.col("bid_1") - F.col("ask_2")).withWatermark("observed_at", watermark)
    return edges.groupBy("candidate", "event_id", F.session_window("observed_at", gap)).agg(
        F.min("observed_at").alias("edge_start"), F.max("observed_at").alias("edge_end"), F.count(F.lit(1)).alias("observations"), F.max("edge").alias("max_edge"), F.avg("edge").alias("avg_edge")
    ).drop("session_window")


def flow(trades: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Five-minute buy and sell flow: batch or stream. trades: market, at, side, usdc."""
    return trades.withWatermark("at", watermark).groupBy("market", F.window("at", "5 minutes")).agg(
        F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.sum("usdc").alias("usdc")
    ).select("market", F.col("window.start").alias("bucket"), "buys", "sells", "usdc")


#: Steps back that a fork may be long: 2^20.
FORK_ROUNDS = 20


def dropped_blocks(spark: SparkSession, headers: DataFrame, old_tip: str, new_tip: str) -> DataFrame:
    """The blocks of the old chain after its last common ancestor with the new one. headers: number, hash, parent.

    Both chains are walked back at once, 1, 2, 4, ... blocks a round, until they meet: the rounds grow with the logarithm of
    the fork's length. Each round's steps are checkpointed. Raises where the chains do not meet within 2^FORK_ROUNDS."""
    blocks = headers.select("number", "hash", "parent").dropDuplicates(["hash"])
    known = blocks.select("hash")
    jump = blocks.join(known.withColumnRenamed("hash", "parent"), "parent").select("hash", F.col("parent").alias("to")).checkpoint()
    chain = known.where(F.col("hash").isin(old_tip, new_tip)).select("hash", (F.col("hash") == old_tip).alias("old"), (F.col("hash") == new_tip).alias("new")).checkpoint()
    for _ in range(FORK_ROUNDS + 1):
        if chain.where("old AND new").take(1):
            break
        before = chain.count()
        stepped = chain.join(jump, "hash").select(F.col("to").alias("hash"), "old", "new")
        chain = chain.unionByName(stepped).groupBy("hash").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new")).checkpoint()
        if chain.count() == before and not chain.where("old AND new").take(1):
            raise ValueError("the chains have no common ancestor")
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.hash")).select("a.hash", "b.to").checkpoint()
    else:
        raise ValueError(f"the chains do not meet within {2**FORK_ROUNDS} blocks")
    chain = chain.join(blocks, "hash")
    ancestor = chain.where("old AND new").agg(F.max("number").alias("ancestor"))
    return chain.where("old").crossJoin(F.broadcast(ancestor)).where("number > ancestor").select("number", "hash", "parent")  # one row


def orphan_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows (block_number, block_hash, final, orphaned) with those of dropped blocks orphaned; raises if one is final."""
    d = dropped.select(F.col("number").alias("block_number"), F.col("hash").alias("block_hash"), F.lit(True).alias("_d"))
    joined = rows.join(d, ["block_number", "block_hash"], "left")
    panic = F.when(F.col("_d") & F.col("final"), F.raise_error(F.lit("a final row would be orphaned"))).otherwise(F.col("orphaned") | F.coalesce("_d", F.lit(False)))
    return joined.withColumn("orphaned", panic).drop("_d")


def burst_guard(failures: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """Adds how many failures of the ticker the last seconds hold, and whether that is too many. failures: ticker, at_s."""
    from pyspark.sql import Window

    recent = Window.partitionBy("ticker").orderBy("at_s").rangeBetween(-seconds, 0)
    return failures.withColumn("recent", F.count(F.lit(1)).over(recent)).withColumn("skip", F.col("recent") > most)
