"""Streams with states and timers against plain replays, whatever the micro-batches; sinks that are killed midway."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import book, runs, sinks, states

LEVELS = "array<struct<price:string,qty:double>>"
MESSAGES = f"ticker string, ms long, seq long, epoch int, kind string, yes {LEVELS}, no {LEVELS}"


def landed(spark, tmp_path, rows, schema, parts):
    """A stream of files, one a batch, each with a stretch of the rows."""
    for i in range(parts):
        n = -(-len(rows) // parts)
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return stream.withColumn("at", F.timestamp_millis("ms")).drop("ms")


def plain_samples(rows, every, end):
    out = []
    for ticker in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == ticker), key=lambda r: (r[1], r[2]))
        for at in range(0, end + 1, every):
            state, ready, epoch, seen = {"yes": {}, "no": {}}, False, None, None
            for _, ms, _, e, kind, yes, no in mine:
                if ms > at:
                    break
                if e != epoch:
                    state, ready, epoch = {"yes": {}, "no": {}}, False, e
                state = book.apply_message(state, kind, {"yes": yes, "no": no})
                ready, seen = ready or kind == "snapshot", ms
            if ready and state["yes"]:
                out.append((ticker, at, *book.mid_spread(state), at - seen))
    return sorted(out, key=str)


def random_messages(seed, n):
    rnd = random.Random(seed)
    ms, rows = 0, []
    for i in range(n):
        ms += rnd.choice([0, 1, 150, 900, 1000, 4000])
        level = lambda: None if rnd.random() < 0.3 else [(f"{rnd.randrange(1, 60) / 100:.2f}", rnd.choice([0.0, 3.0, 7.0, None])) for _ in range(rnd.randrange(3))]
        rows.append((rnd.choice("abc"), ms, i, 1 + (ms > 60_000) + (ms > 90_000), rnd.choice(["snapshot", "delta", "delta", "delta"]), level(), level()))
    return rows, ms


@pytest.mark.parametrize("parts", [1, 4])
def test_samples(spark, tmp_path, parts):
    rows, last = random_messages(6, 120)
    end = last - last % 1000 + 20_000
    rows_end = [*rows, ("", end + 10_000, 0, 0, "delta", None, None)]
    stream = landed(spark, tmp_path, rows_end, MESSAGES, parts)
    got = runs.with_timers(spark, lambda: runs.to_end(states.sampled_books(stream, 1000))).drop("yes_levels").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_samples(rows, 1000, end)
    alarms = states.stale_alarms(spark.createDataFrame(got), 3, 2000).collect()
    at = {r["at_ms"]: sum(x["at_ms"] == r["at_ms"] and x["age_ms"] <= 2000 for x in got) for r in got}
    assert {(r["at_ms"], r["stale"]) for r in alarms} == {(t, 3 - n) for t, n in at.items() if (3 - n) * 2 > 3}


def plain_bursts(rows, window, most, end):
    """At every millisecond that matters: whether more than `most` failures are younger than the window."""
    out = []
    for ticker in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == ticker), key=lambda r: (r[1], r[2]))
        times, fails, skip, i = sorted({r[1] for r in mine} | {r[1] + window for r in mine}), [], False, 0
        for t in (t for t in times if t <= end):
            fails = [x for x in fails if t - x < window]
            if skip and len(fails) <= most:
                skip = False
                out.append((ticker, t, False, len(fails)))
            while i < len(mine) and mine[i][1] == t:
                fails = [] if mine[i][3] else [*fails, t]
                if (len(fails) > most) != skip:
                    skip = not skip
                    out.append((ticker, t, skip, len(fails)))
                i += 1
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_bursts(spark, tmp_path, parts):
    rnd = random.Random(2)
    ms, rows = 0, []
    for i in range(300):
        ms += rnd.choice([0, 500, 2000, 9000, 1, 40_000 if i % 50 == 0 else 3])
        rows.append((rnd.choice("ab"), ms, i, rnd.random() < 0.06))
    end = ms + 200_000
    rows_end = [*rows, ("", end + 10_000, 0, True)]
    stream = landed(spark, tmp_path, rows_end, "ticker string, ms long, seq long, ok boolean", parts)
    got = runs.with_timers(spark, lambda: runs.to_end(states.burst_changes(stream))).collect()
    want = plain_bursts(rows, 60_000, 10, end)
    assert sorted(map(tuple, got)) == want
    assert len(want) > 4
    for ticker, told in itertools.groupby(want, key=lambda r: r[0]):
        assert [r[2] for r in told][:2] == [True, False], ticker


QUOTES = "pair string, event_id long, ms long, price_1 double, price_2 double, parsed boolean"


def quotes(n):
    rnd = random.Random(1)
    rows = [(f"p{i % 4}", i, 1000 + 1000 * i, None if i % 7 == 0 else i / 100, None if i % 5 == 0 else 0.5, i % 9 > 0) for i in range(n)]
    return sorted(rows + rnd.sample(rows, n // 3), key=lambda r: r[2])


def test_observer_killed_between_writes(spark, tmp_path, monkeypatch):
    rows = quotes(90)
    stream = landed(spark, tmp_path, rows, QUOTES, 3).withColumnRenamed("at", "observed_at")
    path, died = f"file://{tmp_path}/tables", []
    whole = sinks.into_tables

    def dying(stream, path, tables, last, **trigger):
        def snapshots(batch):
            if len(died) < 2 and (batch.count() > 0) and (not died or rnd.random() < 0.9):
                died.append(1)
                raise RuntimeError("killed")
            return tables["snapshots"](batch)

        rnd = random.Random(0)
        return whole(stream, path, tables | {"snapshots": snapshots}, last, **trigger)

    monkeypatch.setattr(sinks, "into_tables", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            sinks.observer(stream, path, 4).awaitTermination()
        # What was written before is there, though no batch of it is whole.
        assert spark.read.parquet(f"{path}/spreads").count() > 0
    sinks.observer(stream, path, 4).awaitTermination()
    sinks.observer(stream, path, 4).awaitTermination()  # nothing more to read
    once = sorted(set(rows), key=lambda r: r[1])
    fine = [r for r in once if r[5] and r[3] is not None and r[4] is not None]
    read = lambda name: sinks.committed(spark, path, name, sinks.HEARTBEAT)
    assert sorted(r["event_id"] for r in read("spreads").collect()) == [r[1] for r in fine]
    assert read("snapshots").count() == sum((r[3] is not None) + (r[4] is not None) for r in once if r[5])
    beats = read(sinks.HEARTBEAT)
    assert beats.groupBy("batch").count().where("count > 1").count() == 0
    total = beats.agg(*(F.sum(c) for c in ("attempted", "succeeded", "errors_1", "errors_2", "parse_errors"))).first()
    assert tuple(total) == (len(once), len(fine), sum(r[5] and r[3] is None for r in once), sum(r[5] and r[4] is None for r in once), sum(not r[5] for r in once))
    assert len(died) == 2


def test_settlements_agree_after_a_crash(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    rows = [(rnd.randrange(12), 1, 1000 * (i + 1), i, rnd.choice(["yes", "no"]), i * 10) for i in range(60)]
    stream = landed(spark, tmp_path, rows, "market_id long, provider_id int, ms long, seq long, outcome string, resolved_us long", 4)
    path, died, whole = f"file://{tmp_path}/settled", [], sinks.into_tables

    def dying(stream, path, tables, last, **trigger):
        def changes(batch):
            if len(died) < 2:
                died.append(1)
                raise RuntimeError("killed")
            return tables[last](batch)

        return whole(stream, path, tables | {last: changes}, last, **trigger)

    monkeypatch.setattr(sinks, "into_tables", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            sinks.settlements(stream, path).awaitTermination()
    sinks.settlements(stream, path).awaitTermination()
    history = sinks.settlement_history(spark, path)
    assert sorted(r["seq"] for r in history.collect()) == list(range(60))
    last = {r[0]: (r[3], r[4], r[5]) for r in rows}
    assert {r["market_id"]: (r["seq"], r["outcome"], r["resolved_us"]) for r in sinks.settled(spark, path).collect()} == last
    assert history.select("batch").distinct().count() == 4
