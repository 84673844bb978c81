"""Folds over the rows of a key in order, where each step needs the state that the one before left.

The rows of a key meet in one task, sorted, and stream through it: the memory is that of a batch and one state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

EPS = 1e-9


_ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A row for each row of df: key, order and the state after it (the columns of schema). Rows without a key are one
    key's. Keys and values reach the steps as they are: nulls as None, integers whole."""
    fields = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = f"{key} {kinds[key]}, " + ", ".join(f"{c} {kinds[c]}" for c in order) + f", {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, start(), False
        for batch in batches:
            states = []
            for row in batch.to_pylist():
                if not begun or row[key] != at:
                    at, state, begun = row[key], start(), True
                state = step(state, row)
                states.append(state)
            told = [pa.array([s[name] for s in states], _ARROW[kind]) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(batch.column(c) for c in order), *told], [key, *order, *(name for name, _ in fields)])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def position_step(state: dict, row: dict) -> dict:
    """Position accounting: a trade opens, adds (average cost by weight), closes in part or whole, or flips."""
    net, cost, realized = state["net"], state["cost"], state["realized"]
    delta, price = row["delta"], row["price"]
    if delta is None or price is None or abs(delta) < EPS:
        return state
    if abs(net) < EPS or net * delta > 0:
        total = net + delta
        cost = price if abs(net) < EPS else (abs(net) * cost + abs(delta) * price) / abs(total)
        return {"net": total, "cost": cost, "realized": realized}
    closed = min(abs(net), abs(delta))
    realized += closed * (price - cost) * (1 if net > 0 else -1)
    total = net + delta
    if abs(total) < EPS:
        return {"net": 0.0, "cost": None, "realized": realized}
    return {"net": total, "cost": cost if abs(delta) < abs(net) else price, "realized": realized}


def positions(fills: DataFrame, key: str = "market_id", order: tuple[str, ...] = ("observed_us", "fill_id")) -> DataFrame:
    """The position after each fill: net, average cost (null when flat) and realised profit. fills: key, order, delta, price."""
    return ordered_fold(fills.select(key, *order, "delta", "price"), key, list(order), lambda: {"net": 0.0, "cost": None, "realized": 0.0}, position_step, "net double, cost double, realized double")


def _js_round(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def ema_step(state: dict, row: dict, half_life_ms: float = 30_000) -> dict:
    """An exponential average with a half-life, rounded to 3 digits at each step; confidence grows over 12 readings."""
    x, now = row["x"], row["t_ms"]
    if x is None or math.isnan(x):
        return state
    if state["ema"] is None:
        return {"ema": x, "n": 1, "confidence": 0.08, "at": now}
    dt = now - state["at"] if now > state["at"] else 250
    a = 1 - math.exp(-math.log(2) * dt / half_life_ms)
    n = state["n"] + 1
    return {"ema": _js_round(state["ema"] + a * (x - state["ema"]), 3), "n": n, "confidence": min(1.0, n / 12), "at": now}


def fair_values(readings: DataFrame, key: str = "market_id", order: tuple[str, ...] = ("t_ms",)) -> DataFrame:
    """The half-life average of x after each reading. readings: key, order (t_ms among it), x."""
    return ordered_fold(readings.select(key, *order, "x"), key, list(order), lambda: {"ema": None, "n": 0, "confidence": 0.0, "at": None}, ema_step, "ema double, n int, confidence double")
