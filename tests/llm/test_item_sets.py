"""Benchmark items in sets of a bounded size, very long ones alone."""

import random

from tidemark.llm import decontaminate as D


def test_long_items_are_sets_alone(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    items = [(i, text(20)) for i in range(1, 61)] + [(100, text(3000)), (101, text(3000)), (None, text(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(900, None), (901, text(100))], "doc_id long, text string")
    whole = sorted((r["id"], r["item_id"] or -1) for r in D.contaminated(docs, bench).collect())
    assert whole == sorted((i, -1 if item is None else item) for i, (item, _) in enumerate(items))
    monkeypatch.setattr(D, "MOST_BYTES", 4000)  # of about 16,000 bytes of text
    rows = bench.selectExpr("item_id AS item", "text")
    sizes = [(r["n"], r["b"]) for r in rows.groupBy(D.item_sets(rows, 20).alias("part")).agg({"*": "count", "text": "max"}).toDF("part", "n", "b").collect()]
    assert max(n for n, _ in sizes) <= 20 and len(sizes) > 4
    assert sum(n == 1 and len(b) > 4000 for n, b in sizes) == 2
    cut = sorted((r["id"], r["item_id"] or -1) for r in D.contaminated(docs, bench, most_items=20).collect())
    assert cut == whole
