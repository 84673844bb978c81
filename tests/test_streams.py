import pytest
from pyspark.sql import functions as F

from tidemark.sources import landing
from tidemark.streaming import book

MESSAGE = "ticker string, seq long, kind string, yes array<struct<price:string,qty:string>>, no array<struct<price:string,qty:string>>"
LEVEL = lambda *x: [{"price": p, "qty": q} for p, q in x]
MESSAGES = [
    ("a", 1, "delta", LEVEL(("0.30", "5")), None),
    ("a", 2, "snapshot", LEVEL(("0.26", "11"), ("0.25", "0")), LEVEL(("0.70", "4"))),
    ("a", 3, "delta", LEVEL(("0.27", "2")), None),
    ("a", 4, "delta", LEVEL(("0.27", "0")), LEVEL(("0.70", None), ("0.80", "1"))),
    ("b", 1, "snapshot", LEVEL(("0.10", "1")), None),
]
EXPECTED = {("a", 2): (28.0, 4), ("a", 3): (28.5, 3), ("a", 4): (None, None), ("b", 1): (None, None)}


def test_book_replay(spark):
    got = {(r.ticker, r.seq): (r.mid_cents, r.spread_cents) for r in book.replay(spark.createDataFrame(MESSAGES, MESSAGE)).collect()}
    assert got == EXPECTED


def test_book_stream_is_the_replay(spark, tmp_path):
    spark.createDataFrame(MESSAGES, MESSAGE).coalesce(1).write.json(str(tmp_path / "in"))
    stream = book.stream_books(spark.readStream.schema(MESSAGE).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("books").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert {(r.ticker, r.seq): (r.mid_cents, r.spread_cents) for r in spark.table("books").collect()} == EXPECTED


def test_gap_of_the_threshold_merges(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    rows = None
    for s in (0, 90, 181):
        r = spark.range(1).select(F.lit("c").alias("candidate"), F.lit("e").alias("event_id"), at(s).alias("observed_at"), F.lit(0.5).alias("bid_1"), F.lit(0.4).alias("ask_2"))
        rows = r if rows is None else rows.unionByName(r)
    assert sorted(r.observations for r in book.gap_sessions(rows).collect()) == [1, 2]


@pytest.mark.parametrize("fork", [1, 5])
def test_fork(spark, fork):
    rows = [(i, f"h{i}", f"h{i - 1}") for i in range(10)] + [(10 - fork + i, f"n{i}", f"h{9 - fork}" if i == 0 else f"n{i - 1}") for i in range(fork + 1)]
    headers = spark.createDataFrame(rows, "number long, hash string, parent string")
    dropped = book.dropped_blocks(spark, headers, "h9", f"n{fork}")
    assert {r.hash for r in dropped.collect()} == {f"h{i}" for i in range(10 - fork, 10)}
    trades = spark.createDataFrame([(9, "h9", False, False), (2, "h2", True, False)], "block_number long, block_hash string, final boolean, orphaned boolean")
    assert {r.block_number: r.orphaned for r in book.orphan_rows(trades, dropped).collect()} == {9: True, 2: False}
    with pytest.raises(Exception, match="final row"):
        book.orphan_rows(trades.withColumn("final", F.lit(True)), dropped).collect()


def test_no_common_ancestor(spark):
    headers = spark.createDataFrame([(1, "a", None), (1, "b", None)], "number long, hash string, parent string")
    with pytest.raises(ValueError):
        book.dropped_blocks(spark, headers, "a", "b")


def test_landing(spark):
    p = spark.createDataFrame([('{"markets":[{"ticker":"A","yes_bid":0.4,"yes_ask":null},{"ticker":"B","yes_bid":0.1,"yes_ask":1.5}]}',)], "payload string")
    assert [(r.ticker, r.yes) for r in landing.price_map(p).collect()] == [("A", 0.4)]
    q = spark.createDataFrame([('{"markets":[{"question":"q","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"0.3\\",\\"0.7\\"]"}]}',)], "payload string")
    assert [(r.outcome, r.price) for r in landing.outcome_prices(q).collect()] == [("Yes", 0.3), ("No", 0.7)]
    d, m = (spark.createDataFrame(x, "t long, p double") for x in ([(1, 0.1), (2, 0.2)], [(2, 0.25), (3, 0.3)]))
    assert sorted(map(tuple, landing.merge_histories(d, m).collect())) == [(1, 0.1), (2, 0.25), (3, 0.3)]


def test_burst_guard(spark):
    rows = spark.createDataFrame([("a", i) for i in range(12)] + [("a", 200)], "ticker string, at_s long")
    got = {r.at_s: r.skip for r in book.burst_guard(rows).collect()}
    assert got[9] is False and got[10] is True and got[200] is False
