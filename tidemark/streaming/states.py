"""Streams with a state for each ticker and timers: sampled order books and the guard against bursts of failures.

Both go through a ticker's rows in order of time, whatever order they came in: a row waits in the state until the
watermark has passed it. So the result depends on the rows alone, not on how they fell into micro-batches. They need a
session whose spark.sql.streaming.stateStore.providerClass is RocksDB's."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .book import apply_message, mid_spread, top

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The window of failures in milliseconds, and how many of them are still no burst.
WINDOW_MS, MOST_FAILURES = 60_000, 10


class InOrder(StatefulProcessor):
    """Steps through a key's rows (ms, seq, body as JSON) in order. Subclasses say what a row and the passing of time do to
    the state, a dictionary that JSON can hold, and give rows in the order of `columns`."""

    columns: tuple[str, ...] = ()

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, key: tuple, state: dict, ms: int, body: dict) -> Iterable[tuple]:
        raise NotImplementedError

    def pass_to(self, key: tuple, state: dict, ms: int) -> Iterable[tuple]:
        """What happens on its own up to and including ms."""
        return ()

    def wake_at(self, state: dict) -> int | None:
        """When something will happen on its own."""
        return None

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")
        self.waiting = handle.getListState("waiting", "ms long, seq long, body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            came = list(zip(frame["ms"].tolist(), frame["seq"].tolist(), frame["body"].tolist(), strict=True))
            if came:
                self.waiting.appendList(came)
                first = min([r[0] for r in came] + ([] if first is None else [first]))
        if first is not None:
            self._timer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        out = []
        for ms, _, body in due:
            out += self.pass_to(key, state, ms - 1)
            out += self.step(key, state, ms, json.loads(body))
        out += self.pass_to(key, state, now)
        self.state.update((json.dumps(state),))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        wake = [x for x in (later[0][0] if later else None, self.wake_at(state)) if x is not None]
        if wake:
            self._timer(min(wake), now)
        yield pd.DataFrame(out, columns=list(self.columns))

    def _timer(self, ms: int, now: int = -1) -> None:
        known = [t for t in self.handle.listTimers() if t > now]  # the one that has just expired is still listed
        if not known or min(known) > ms:
            for old in known:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class SampledBook(InOrder):
    """A ticker's book at every multiple of `every` milliseconds, the last known carried forward. A message of a new
    connection (epoch) empties it; nothing is given before the connection's first snapshot, nor while no one bids yes."""

    columns = ("ticker", "at_ms", "mid_cents", "spread_cents", "age_ms", "yes_levels")

    def __init__(self, every: int):
        self.every = every

    def start(self) -> dict:
        return {"yes": [], "no": [], "ready": False, "epoch": None, "seen": None, "next": None}

    def step(self, key, state, ms, body) -> Iterable[tuple]:
        if body.get("epoch") != state["epoch"]:
            state |= {"yes": [], "no": [], "ready": False, "epoch": body.get("epoch"), "seen": None, "next": None}
        book = {s: {int(p): q for p, q in state[s]} for s in ("yes", "no")}
        sides = {s: None if body.get(s) is None else [(x["price"], x.get("qty")) for x in body[s]] for s in ("yes", "no")}
        book = apply_message(book, body["kind"], sides)
        state |= {s: sorted(book[s].items()) for s in ("yes", "no")} | {"seen": ms, "ready": state["ready"] or body["kind"] == "snapshot"}
        if state["ready"] and state["next"] is None:
            state["next"] = -(-ms // self.every) * self.every
        return ()

    def pass_to(self, key, state, ms) -> Iterable[tuple]:
        if not state["ready"] or state["next"] is None or state["next"] > ms:
            return
        book = {s: {int(p): q for p, q in state[s]} for s in ("yes", "no")}
        mid, spread = mid_spread(book)
        levels = len(top(book["yes"]))
        for at in range(state["next"], ms + 1, self.every):
            if levels:
                yield key[0], at, mid, spread, at - state["seen"], levels
        state["next"] = (ms // self.every + 1) * self.every

    def wake_at(self, state) -> int | None:
        return state["next"] if state["ready"] else None


class BurstGuard(InOrder):
    """When a ticker is left alone and when no more: it is while more than `most` failures are younger than `window`
    milliseconds; a success forgets them all. A row for each change."""

    columns = ("ticker", "at_ms", "skip", "failures")

    def __init__(self, window: int = WINDOW_MS, most: int = MOST_FAILURES):
        self.window, self.most = window, most

    def start(self) -> dict:
        return {"failures": [], "skip": False}

    def _told(self, key, state, ms) -> Iterable[tuple]:
        skip = len(state["failures"]) > self.most
        if skip != state["skip"]:
            state["skip"] = skip
            yield key[0], ms, skip, len(state["failures"])

    def step(self, key, state, ms, body) -> Iterable[tuple]:
        state["failures"] = [] if body["ok"] else [t for t in state["failures"] if ms - t < self.window] + [ms]
        yield from self._told(key, state, ms)

    def pass_to(self, key, state, ms) -> Iterable[tuple]:
        while (at := self.wake_at(state)) is not None and at <= ms:
            state["failures"] = [t for t in state["failures"] if at - t < self.window]
            yield from self._told(key, state, at)

    def wake_at(self, state) -> int | None:
        """When enough failures are old enough that the ticker is no longer left alone; else the state just lies there, and
        its next row forgets what is old."""
        return state["failures"][-self.most - 1] + self.window if state["skip"] else None


def _rows(stream: DataFrame, body: list[str], watermark: str) -> DataFrame:
    """stream: ticker, at (timestamp), seq and the columns of body."""
    told = F.to_json(F.struct(*body), {"ignoreNullFields": "true"})
    return stream.withWatermark("at", watermark).select("ticker", "at", F.unix_millis("at").alias("ms"), F.col("seq").cast("long").alias("seq"), told.alias("body"))


def sampled_books(messages: DataFrame, every_ms: int = 1000, watermark: str = "10 seconds") -> DataFrame:
    """ticker, at_ms, mid_cents, spread_cents, age_ms (since its last message), yes_levels. messages: a stream of ticker, at,
    seq, epoch (of the connection), kind, yes, no (arrays of price and qty, or null)."""
    rows = _rows(messages, ["epoch", "kind", "yes", "no"], watermark)
    kinds = "ticker string, at_ms long, mid_cents double, spread_cents int, age_ms long, yes_levels int"
    return rows.groupBy("ticker").transformWithStateInPandas(statefulProcessor=SampledBook(every_ms), outputStructType=kinds, outputMode="Append", timeMode="EventTime")


def burst_changes(placements: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST_FAILURES, watermark: str = "10 seconds") -> DataFrame:
    """ticker, at_ms, skip, failures. placements: a stream of ticker, at, seq, ok (whether an order was placed)."""
    rows = _rows(placements, ["ok"], watermark)
    kinds = "ticker string, at_ms long, skip boolean, failures int"
    return rows.groupBy("ticker").transformWithStateInPandas(statefulProcessor=BurstGuard(window_ms, most), outputStructType=kinds, outputMode="Append", timeMode="EventTime")


def stale_alarms(samples: DataFrame, tickers: int, stale_ms: int) -> DataFrame:
    """(at_ms, stale): the samples at which more than half of the tickers had no message for stale_ms, or no book."""
    fresh = samples.groupBy("at_ms").agg(F.count_if(F.col("age_ms") <= stale_ms).alias("fresh"))
    return fresh.select("at_ms", (F.lit(tickers) - F.col("fresh")).alias("stale")).where(F.col("stale") * 2 > tickers)
