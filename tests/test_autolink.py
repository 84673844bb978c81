"""The auto-link pass against a plain loop; a second pass over what the first wrote."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.autolink import LEAGUES, auto_link

MARKETS = "market_id long, provider_id int, category string, sport string, status string, home string, away string, game_day int, anchor_day int, last_seen_us long, template string"
EVENTS = "event_id long, category string, subcategory string, day int, title string"
MAPPED = "market_id long, provider_id int, event_id long, slot_id string, template string, score double"


def fits(m, e):
    return [1.0, 0.9, 0.5, 0.49, 0.1, 0.9][(m * 7 + e * 3) % 6]


def plain(markets, events, mapped, linked, most):
    held = {r[0] for r in mapped}
    tiers = defaultdict(list)
    none_last = lambda x: (x is None, -(x or 0))
    for m in markets:
        if m[0] not in held and m[4] in (None, "active", "open"):
            tiers[m[1], 0 if m[5] and m[6] and m[7] is not None else 1].append(m)
    ranked = []
    for (_, known), rows in tiers.items():
        order = lambda m: (0 if (m[3] or "").lower() in LEAGUES else 1, none_last(m[9]), -m[0])
        ranked += [((known, i, *order(m)), m) for i, m in enumerate(sorted(rows, key=order), 1)]
    attached, left = [], []
    for _, m in sorted(ranked)[:most]:
        near = [e for e in events if m[8] is not None and e[1] == m[2] and abs(e[3] - m[8]) <= 1]
        own = [e for e in near if (m[3] or "").lower() in LEAGUES and e[2] == m[3].lower()]
        best, score = None, -1
        for e in sorted(own or near, key=lambda e: (e[3], e[4], e[0])):
            if fits(m[0], e[0]) > score:
                best, score = e, fits(m[0], e[0])
        if best is None or score < 0.5:
            left.append((m[0], "no_event" if best is None else "low_confidence"))
        else:
            attached.append((m[0], m[1], best[0], f"{best[0]}:{m[10] or 'unknown'}", score))
    slots = {a[3] for a in attached} - {r[3] for r in mapped}
    legs = defaultdict(list)
    for m, p, _, slot, score in [(r[0], r[1], r[2], r[3], r[5]) for r in mapped] + attached:
        legs[slot].append((m, p, score))
    links = [(slot, m, p, min(x[2] for x in rows)) for slot, rows in legs.items() if sorted(x[1] for x in rows) == [1, 2] and not any(x[0] in linked for x in rows) for m, p, _ in rows]
    return sorted(attached), sorted(slots), sorted(links), sorted(left)


@pytest.mark.parametrize("seed,most", [(1, 500), (2, 40)])
def test_pass_is_the_loop_and_is_done_once(spark, seed, most):
    rnd = random.Random(seed)
    pick = rnd.choice
    markets = []
    for i in range(160):
        day = pick([None, 10, 11, 12, 13, 20])
        markets.append((i, 1 + rnd.randrange(2), pick(["sports", "sports", "politics", "crypto"]), pick(["mlb", "NBA", "golf", None, ""]), pick(["active", "open", None, "closed"]), pick(["a", None]), pick(["b", "b", None]), day, day, pick([None, 5, 6, 7]), pick(["w", "t", "u", None])))
    events = [(i, pick(["sports", "politics"]), pick(["mlb", "nba", "x", None]), pick([9, 10, 11, 12, 13, 14]), pick(["p", "q", "r"])) for i in range(40)]
    mapped = [(1000 + i, 1 + i % 2, i % 40, f"{i % 40}:w", "w", 0.8) for i in range(12)]
    linked = {3, 10, 77, 1001}
    e = spark.createDataFrame(events, EVENTS)
    score = lambda: F.element_at(F.array(*map(F.lit, [1.0, 0.9, 0.5, 0.49, 0.1, 0.9])), (F.pmod(F.col("market_id") * 7 + F.col("e_event_id") * 3, F.lit(6)) + 1).cast("int"))
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "market_id long")

    def run(mapped, linked):
        p = auto_link(spark.createDataFrame(markets, MARKETS), e, spark.createDataFrame(mapped, MAPPED), ids(linked), score, most=most)
        rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
        return rows(p.attachments, "market_id", "provider_id", "event_id", "slot_id", "score"), [r[0] for r in rows(p.slots, "slot_id")], rows(p.links, "slot_id", "market_id", "provider_id", "confidence"), rows(p.leftovers, "market_id", "reason")

    first = run(mapped, linked)
    assert first == plain(markets, events, mapped, linked, most)
    assert all(first)
    template = {m[0]: m[10] for m in markets}
    mapped2 = mapped + [(m, p, ev, slot, template[m], s) for m, p, ev, slot, s in first[0]]
    linked2 = linked | {m for _, m, _, _ in first[2]}
    second = run(mapped2, linked2)
    assert second == plain(markets, events, mapped2, linked2, most)
    if most > 160:
        assert second[:3] == ([], [], []) and second[3] == first[3]


def test_nothing(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    p = auto_link(none(MARKETS), none(EVENTS), none(MAPPED), none("market_id long"), lambda: F.lit(1.0))
    assert [x.count() for x in (p.attachments, p.slots, p.links, p.leftovers)] == [0, 0, 0, 0]
