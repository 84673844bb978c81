"""Pools of texts with keys in common: signatures keep boilerplate from chaining them, and lose no pair of 0.8."""

import random

import numpy as np
import pytest
from test_resemblance import copy_of, jaccard, words


@pytest.mark.parametrize("n", [12, 60, 200, 1000])
@pytest.mark.parametrize("kind", ["append", "cut", "passage", "edit"])
def test_signatures_of_copies_agree(kind, n):
    from tidemark.llm.resemblance import ALIKE, SIGNS, min_hashes, shingle_set, signature

    rnd, tried = random.Random(n), 0
    for _ in range(100):
        base = words(rnd, n, 3000)
        other = copy_of(rnd, base, kind, 3000)
        if jaccard(base, other) >= 0.8:
            tried += 1
            a, b = (np.frombuffer(signature(min_hashes(shingle_set(" ".join(t).encode()))), np.uint8) for t in (base, other))
            assert len(a) == SIGNS and (a == b).sum() >= ALIKE
    assert tried > 50 or n == 12


def test_boilerplate_chain(spark):
    """20,000 texts, each with boilerplate of the one before and of the one after it: all share keys with their neighbours,
    and no pool grows beyond the copies put in."""
    from tidemark.llm import resemblance

    rnd = random.Random(1)
    shared = [words(rnd, 40, 20_000) for _ in range(20_001)]
    texts = [" ".join(shared[i] + words(rnd, 40, 20_000) + shared[i + 1]) for i in range(20_000)]
    copies = [texts[i] + " one more" for i in range(0, 20_000, 400)]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "id long, text string").repartition(8)
    prints = resemblance.written(docs.select("id", "text").mapInArrow(resemblance._prints, "id long, node long, n long, fp long, bands array<long>, signs binary"), "prints")
    nodes = prints.drop("id").dropDuplicates(["node"])
    pooled = resemblance.pools(nodes).groupBy("pool").count()
    assert pooled.agg({"count": "max"}).first()[0] <= 4
    assert pooled.count() >= len(copies)
    found = resemblance.near_copies(docs, ["id"]).groupBy("root").count().where("count > 1")
    assert sorted(r["count"] for r in found.collect()) == [2] * len(copies)


@pytest.mark.parametrize("block", [3, 1024])
def test_one_key_in_blocks(spark, monkeypatch, block):
    from tidemark.llm import resemblance

    monkeypatch.setattr(resemblance, "TEXT_BLOCK", block)
    rnd = np.random.default_rng(5)
    bases = rnd.integers(0, 256, (4, resemblance.SIGNS), np.uint8)
    rows = []
    for i in range(40):
        signs = bases[i % 4].copy()
        signs[: i // 4] = 0
        rows.append((i, bytearray(signs.tobytes()), [7] if i % 4 < 3 else [7, 8]))
    nodes = spark.createDataFrame(rows, "node long, signs binary, bands array<long>")
    up = list(range(40))
    for r in resemblance.alike(nodes).collect():
        up = [up[r["b"]] if x == up[r["a"]] else x for x in up]
    assert all((up[i] == up[j]) == (i % 4 == j % 4) for i in range(40) for j in range(40))
