"""Probes of long segments are made in the tasks."""

import random

import pytest


@pytest.mark.parametrize("segments", [3, 4])
def test_far_neighbours_without_lists_on_the_driver(spark, monkeypatch, segments):
    from tidemark.llm.topk import exact_top_k

    rnd = random.Random(segments)
    codes = [(i, rnd.getrandbits(63)) for i in range(60)]
    far = [(1000, codes[0][1] ^ sum(1 << b for b in rnd.sample(range(63), 12)))]
    kind = "id long, code long"
    rows, queries = spark.createDataFrame(codes, kind), spark.createDataFrame(far, kind)

    def listed(*_, **__):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", listed)
    got = [(r["rank"], r["id"], r["distance"]) for r in exact_top_k(rows, queries, 1, segments).collect()]
    distance, best = min(((c ^ far[0][1]).bit_count(), i) for i, c in codes)
    assert got == [(1, best, distance)]


@pytest.mark.parametrize("segments", [2, 3])
def test_few_segments(spark, segments):
    from tidemark.llm.topk import exact_top_k

    rnd = random.Random(segments)
    base = [rnd.getrandbits(64) for _ in range(6)]
    codes = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(12)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = [tuple(r) for r in exact_top_k(df, df.where("id % 24 = 0"), 4, segments=segments).orderBy("query_id", "rank").collect()]
    want = [(q, k + 1, i, d) for q in range(0, len(codes), 24) for k, (d, i) in enumerate(sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:4])]
    assert got == want


def test_nan_is_not_above_zero(spark):
    from tidemark.llm.topk import sign_code

    df = spark.createDataFrame([([float("nan")] + [1.0] * 63,), ([None] + [1.0] * 63,)], "v array<float>")
    assert [r[0] for r in df.select(sign_code("v")).collect()] == [-2, None]
