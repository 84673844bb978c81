import pytest
from pyspark.sql import functions as F

from tidemark.functions import listings, quoting


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def L(x):
    return F.lit(x)


def test_rotation_score(spark):
    score = lambda v, k, h, a: value(spark, quoting.rotation_score(L(v), L(k), L(h), L(0.40), L(a)))
    assert score(100_000.0, "sports", 4.0, 0.45) == 150_000
    assert score(100_000.0, "finance", 4.0, 0.45) == 0
    assert score(1_000_000.0, "sports", 720.0, 0.45) == 300_000
    assert score(100_000.0, "sports", 4.0, 0.41) == 0


def test_categories(spark):
    assert value(spark, quoting.category(L("KXNBAGAME-1"), L(None).cast("string"), L(None).cast("string"))) == "sports"
    assert value(spark, quoting.sport_key(L("KXMLBGAME-1"), L(""), L(""))) == "sports:mlb"
    assert value(spark, quoting.category(L("X"), L("Y"), L("Entertainment"))) == "culture"
    assert value(spark, quoting.category(L("X"), L("Y"), L(None).cast("string"))) == "DEFAULT"
    assert str(value(spark, quoting.game_start(L("KXMLBGAME-26APR281905ABC")).cast("string"))) == "2026-04-28 19:05:00"
    assert value(spark, quoting.game_start(L("KXMLB-26"))) is None


def test_quotes(spark):
    q = lambda **k: value(spark, quoting.quote(*(L(k.get(n, d)) for n, d in (("fair", 50.0), ("net", 0.0), ("soft", 2.0), ("hard", 10.0), ("base", 4.0), ("half", 3.0), ("skew", 8.0))), L(k.get("bid")).cast("double"), L(k.get("ask")).cast("double"), L(1000.0)))
    r = q()
    assert (r.bid, r.ask, r.bid_size, r.ask_size, r.skew) == (47, 53, 4, 4, 0)
    assert q(net=10.0).skew == -8 and q(net=10.0).bid_size == 0
    assert q(net=-6.0).skew == 4
    assert q(ask=1.0).bid is None and q(bid=99.0).ask is None
    assert q(net=5.0).bid_size == 2


def test_gates(spark):
    base = dict(kill=False, enabled=True, net=1.0, hard=5.0, pnl=0.0, loss=100.0, age=1.0, stale=60.0, bid=10.0, ask=10.0, most=100.0, fair=50.0, tox=0.0, above=500.0)
    gate = lambda **k: value(spark, quoting.failed_gate(*(L(v) for v in (base | k).values())))
    assert gate() is None
    for change, name in (
        ({"kill": True}, "kill_switch"), ({"enabled": False}, "market_disabled"), ({"net": 6.0}, "position_hard"), ({"pnl": -100.0}, "daily_loss"), ({"age": 61.0}, "stale_snapshot"),
        ({"bid": 101.0}, "notional_cap"), ({"fair": 99.5}, "fair_value_range"), ({"tox": 500.0}, "toxicity_score"), ({"kill": True, "tox": 900.0}, "kill_switch"),
    ):
        assert gate(**change) == name


@pytest.mark.parametrize(
    ("days", "teams", "unknown", "score"),
    [(0, ("Lakers FC", "Celtics"), False, 1.0), (1, ("Celtics", "Lakers"), False, 0.92), (0, ("LA Lakers", "Celtics"), False, 0.9), (0, ("LA Lakers", "Celtics"), True, 0.6), (0, ("Bulls", "Heat"), False, 0.08), (3, ("Lakers", "Celtics"), False, 0.25), (None, ("Lakers", "Celtics"), False, 0.12), (0, ("", "Celtics"), False, 0.0)],
)
def test_sports_attachment(spark, days, teams, unknown, score):
    c = listings.sports_attachment(L("Lakers"), L("Celtics"), L(teams[0]), L(teams[1]), L(days).cast("int"), L(unknown))
    assert value(spark, c) == score


def test_listings(spark):
    assert value(spark, listings.team(L("Al-Hilal Saudi Club FC"))) == "al hilal"
    assert value(spark, listings.is_matchup(L("A at B"))) and not value(spark, listings.is_matchup(L("Will X win at least 5?")))
    assert value(spark, listings.bucket_template(L("Over 4.5 runs"))) == "sports-total"
    assert value(spark, listings.bucket(L("nothing here"))) is None
    assert value(spark, listings.with_synonyms(L("GOP wins; dem loses"))) == "republican wins; democratic loses"
    assert value(spark, listings.entity(L("Will John Q. Smith Jr. win"))) == "john smith jr"
    assert set(value(spark, listings.race_tokens(L("GA-14 and Senate NV")))) >= {"ga14", "senate-nv"}
    assert value(spark, listings.is_placeholder(L("Yes 2"))) and not value(spark, listings.is_placeholder(L("Bob")))
    none = F.array().cast("array<string>")
    assert value(spark, listings.same_entity(L("jane doe"), L("john doe"), none, none))
    assert not value(spark, listings.same_entity(L("jane doe"), L("max power"), none, none))
    assert value(spark, listings.sports_pair_fault(L("nba"), L("nba"), L(2), L("a|b"), L("a|b"))) == "game_date_delta_gt_1"
    assert value(spark, listings.guard_fault(L("governor_oh_2026"), L("party"), L("binary_yesno"), L("unknown"), L("unknown"))) == "semantic_guard_party_vs_binary_yesno"
    assert value(spark, listings.guard_fault(L("tariffs"), L("party"), L("binary_yesno"), L("unknown"), L("unknown"))) is None
    assert value(spark, listings.phase(L("x#Yes"), L("Primary winner"))) == "primary_or_nominee"
