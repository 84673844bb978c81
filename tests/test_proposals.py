"""Pairs of blocks, decisions on them, and the run that goes through them in order, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decisions
from tidemark.operators import proposals
from tidemark.operators.matching import best_matching
from tidemark.plans import proposing

PAIRS = "block string, direction int, weight double, a long, b long, kind string, attach boolean"


def plain_run(pairs, per_block, most):
    """The loop: one block after the other, the pairs of a block in order."""
    out, counts = [], dict.fromkeys(most, 0)
    for block in sorted({p[0] for p in pairs}):
        seen, linked, n = set(), set(), 0
        for p in sorted((p for p in pairs if p[0] == block), key=lambda p: (p[1], -p[2], p[3], p[4])):
            _, direction, _, a, b, kind, attach = p
            if any(counts[k] >= most[k] for k in most):
                return out
            if n >= per_block:
                break
            if kind not in ("accepted", "equivalent", "proxy") or (a, b) in seen or min(a, b) in linked:
                continue
            seen.add((a, b))
            n += 1
            if kind == "accepted":
                source = a if direction == 0 else b
                linked |= {source} if attach else {a, b}
            else:
                counts[kind] += 1
            out.append((block, direction, a, b, kind))
    return out


def random_pairs(seed, blocks, n, listings, accepted):
    rnd = random.Random(seed)
    out = set()
    for block in range(blocks):
        for _ in range(n):
            a, b = 1000 * block + rnd.randrange(listings), 1000 * block + rnd.randrange(listings)
            kind = "accepted" if rnd.random() < accepted else rnd.choice(["equivalent", "proxy", "skipped"])
            out.add((f"b{block:03d}", rnd.randrange(2), rnd.randrange(5) / 4, a, b, kind, rnd.random() < 0.4))
    once = {(p[0], p[1], p[3], p[4]): p for p in sorted(out)}  # a pair once in a direction
    return list(once.values())


@pytest.mark.parametrize("seed,blocks,n,listings,accepted,per_block,most", [
    (1, 6, 60, 12, 0.5, 50, {"equivalent": 200, "proxy": 200}),
    (2, 20, 90, 40, 0.1, 50, {"equivalent": 200, "proxy": 200}),
    (3, 5, 40, 6, 0.9, 3, {"equivalent": 2, "proxy": 100}),
    (4, 4, 150, 60, 0.0, 50, {"equivalent": 30, "proxy": 1000}),
    (5, 1, 300, 9, 1.0, 1000, {"equivalent": 1, "proxy": 1}),
])
def test_run_is_the_loop(spark, seed, blocks, n, listings, accepted, per_block, most):
    pairs = random_pairs(seed, blocks, n, listings, accepted)
    got = proposals.run_of(spark.createDataFrame(pairs, PAIRS).repartition(5), per_block, most)
    want = plain_run(pairs, per_block, most)
    assert [tuple(r) for r in got.orderBy("block", "at").select("block", "direction", "a", "b", "kind").collect()] == want
    assert want


def test_run_of_nothing(spark):
    assert proposals.run_of(spark.createDataFrame([], PAIRS)).count() == 0


def test_chain_of_items_that_wait(spark):
    """Each item touches what the next needs: every second one is taken, though none can be known before those before it."""
    rows = [("b", i, [f"k{i}"], [f"k{i + 1}"]) for i in range(12)]
    got = proposals.first_come(spark.createDataFrame(rows, "block string, at int, needs array<string>, touches array<string>"))
    assert sorted(r["at"] for r in got.collect()) == list(range(0, 12, 2))


def test_hot_block_is_a_grid(spark):
    left = [("hot", i) for i in range(50)] + [("cold", i) for i in range(100, 103)] + [("alone", 200), (None, 1)]
    right = [("hot", i) for i in range(37)] + [("cold", i) for i in range(100, 102)] + [("other", 300), (None, 1)]
    a, b = spark.createDataFrame(left, "block string, a long"), spark.createDataFrame(right, "block string, b long")
    got = sorted(map(tuple, proposals.block_pairs(a, b, "block", "a", "b", cell=8).collect()))
    assert got == sorted((x, i, j) for x, i in left for y, j in right if x == y and x)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tasks = proposals.block_pairs(a, b, "block", "a", "b", cell=8).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in tasks) < 0.6 * 50 * 37  # of four tasks


def plain_verdict(block, f, equivalent, proxy, attach, nameless):
    g, p = block.startswith("governor_"), block.startswith(("pres_", "nominee"))
    least = 0.25 if g else 0.40 if p else 0.5
    if equivalent < least and proxy < least:
        return "skipped", None, "low_confidence"
    if f["fault"]:
        return "skipped", None, f["fault"]
    if equivalent >= (0.92 if attach else 0.985):
        return "accepted", equivalent, "attach_to_family" if attach else "new_pair"
    if (0.78 if g or p else 0.92) <= equivalent < 0.985:
        if f["title"] < 0.3 and f["slug"] < 0.2:
            return "skipped", None, "titles_differ"
        return "equivalent", equivalent, "confidence"
    if not nameless and (0.60 if g else 0.70 if p else 0.86) <= proxy < 0.98:
        return "proxy", proxy, "topic_or_entity_match"
    if f["cosine"] is not None and f["cosine"] >= 0.87 and f["shared"]:
        return "proxy", f["cosine"], "embedding_cosine_gate"
    return "skipped", None, "low_confidence"


def test_verdicts(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(1500):
        pick = lambda xs: rnd.choice(xs)
        near = [0.0, 0.24, 0.25, 0.39, 0.4, 0.5, 0.6, 0.7, 0.77, 0.78, 0.86, 0.9, 0.92, 0.97, 0.985, 1.0]
        rows.append((i, pick(["governor_oh_2026", "pres_nominee_us_2028", "nominee", "senate_tx_2026", "Governor_x", "other"]), pick([0.0, 0.29, 0.3, 0.8]), pick([0.0, 0.19, 0.2, 0.5]), pick([None, 0.1, 0.87, 0.9]), rnd.random() < 0.5, pick([None, None, None, "guard"]), pick(near), pick(near), rnd.random() < 0.5, rnd.random() < 0.3))
    df = spark.createDataFrame(rows, "i int, block string, title double, slug double, cosine double, shared boolean, fault string, equivalent double, proxy double, attach boolean, nameless boolean")
    f = {c: F.col(c) for c in ("title", "slug", "cosine", "shared", "fault")}
    got = df.select("i", decisions.verdict(F.col("block"), f, F.col("equivalent"), F.col("proxy"), F.col("attach"), F.col("nameless")).alias("v")).collect()
    want = {r[0]: plain_verdict(r[1].lower(), dict(zip(("title", "slug", "cosine", "shared", "fault"), r[2:7], strict=True)), *r[7:]) for r in rows}
    assert {r["i"]: tuple(r["v"]) for r in got} == want
    assert {w[0] for w in want.values()} == {"skipped", "accepted", "equivalent", "proxy"}


def test_whole_run_is_the_loop(spark):
    """The registered run: matched by race and direction, then gone through in order."""
    sf = "/root/testdata/sf0.001"
    pairs = proposing.weighed(proposing.elections(spark, sf)).select("block", "direction", "weight", "a", "b", "kind", "attach").collect()
    kept = []
    for place in {(p["block"], p["direction"]) for p in pairs}:
        mine = {(p["a"], p["b"]): p for p in pairs if (p["block"], p["direction"]) == place}
        kept += [tuple(mine[a, b]) for a, b, _ in best_matching([(a, b, p["weight"]) for (a, b), p in sorted(mine.items())])]
    got = proposing.proposal_run(spark, sf).orderBy("block", "at").select("block", "direction", "a", "b", "kind").collect()
    assert [tuple(r) for r in got] == plain_run(kept, proposals.PER_BLOCK, {"equivalent": proposals.MOST_EQUIVALENT, "proxy": proposals.MOST_PROXY})
    assert got
