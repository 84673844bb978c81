"""Teams of titles and sports of listings: known cases, and titles cut by a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import matchups, sports, templates


def one(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_title(title):
    s = re.sub(r"\s+", " ", title or "").strip()
    for _ in range(24):
        for p in matchups.TITLE_ENDS:
            m = re.search(p, s, re.I)
            if m and m.start() > 0:
                s = s[: m.start()].strip()
                break
        else:
            break
    return re.sub(r"[?:.,;]+$", "", s).strip()


def plain_team(name):
    s = re.sub(r"\s+", " ", name or "").strip()
    for _ in range(12):
        before = s
        for p in matchups.TEAM_ENDS:
            m = re.search(p, s, re.I)
            if m:
                s = s[: m.start()].strip()
        s = re.sub(r"^[?.:;,]+|[?.:;,]+$", "", s).strip()
        if s == before:
            break
    return s[:100]


ENDS = ["first 5 innings runs?", "Winner?", ": 2nd half", "O/U 8.5", "spread", ": Final", "runs", "?", "total goals", "1st inning", "(-3.5)", ": Set 2", "moneyline now", ".", ": Inter match?"]


def test_titles_and_teams_as_loops(spark):
    rnd = random.Random(4)
    titles = [None, "", " ", "Winner?", ":"] + [" ".join([rnd.choice(["A's vs New York M", "Kings", "a @ b"]), *rnd.choices(ENDS, k=rnd.randrange(6))]) for _ in range(150)]
    assert one(spark, titles, "string", matchups.without_market) == [plain_title(t) for t in titles]
    assert one(spark, titles, "string", matchups.clean_team) == [plain_team(t) for t in titles]


@pytest.mark.parametrize("title,want", [
    ("A's vs New York M first 5 innings runs?", ("A's", "New York M")),
    ("Athletics vs. New York Yankees Winner?", ("Athletics", "New York Yankees")),
    ("Miami Winner? vs Boston Winner?", ("Miami", "Boston")),
    ("Will Ducks vs Kings end in a draw?", ("Ducks", "Kings")),
    ("Will Ducks win the Kings vs Blues : Final", None),
    ("Rain at least once", None), ("Kings", None), (None, None), ("", None), ("? vs ?", None),
])
def test_known_titles(spark, title, want):
    (got,) = one(spark, [title], "string", matchups.teams)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("tags,title,tag_id,ref,slug,want", [
    (["wwoh"], "x", None, None, None, "nhl"), (["bkfibaqeu"], "x", None, None, None, "nba"), ([], None, "100100", None, None, "soccer"), ([], None, "100088", None, None, "nhl"),
    ([], "", "99999999", None, None, "unknown"), (["foo", "bar", "678"], "", None, None, None, "mlb"), (None, None, None, "mls-lag-rsl-2026-04-26-total-3pt5", None, "soccer"),
    (None, None, None, "nhl-sj-wpg-2026-04-16", None, "nhl"), (None, None, None, "j1100-san-vva", None, "soccer"), (None, None, None, None, "who-will-win-mls-match", "soccer"),
    (None, "Premier League: Arsenal vs. Liverpool", None, None, None, "soccer"), (None, "Ismaily SC vs. Modern SC", None, None, None, "unknown"), (["itsb"], "ATP final", None, None, None, "tennis"),
    (["sports"], "x", None, None, None, "unknown"), (["Liv-Golf", "nfl"], "x", None, None, None, "nfl"), (["la-liga"], "x", None, None, None, "soccer"), (["1"], "NFL", None, None, None, "nfl"),
])
def test_known_sports(spark, tags, title, tag_id, ref, slug, want):
    df = spark.createDataFrame([(tags, title, tag_id, ref, slug)], "tags array<string>, title string, tag_id string, ref string, slug string")
    assert df.select(sports.sport(*(F.col(c) for c in df.columns)).alias("s")).first()["s"] == want


def test_series(spark):
    cases = [("Final", "KXLOLGAME", "esports"), ("Final", "KXKHLGAME", "hockey"), ("NFL week 1", "KXKHLGAME", "nfl"), ("Final", None, "unknown"), (None, "KXKHLGAME", "unknown"), ("Final", "SUPERLIGRUGBY", "rugby")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, s string, want string")
    got = df.select("i", "want", sports.by_title(F.col("t"), F.col("s")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_sports_kinds_of_titles(spark):
    cases = {
        "Will A vs B end in a draw?": "moneyline_winner", "A vs B first 5 innings runs": "totals", "A vs B O/U 8.5": "totals", "Spread: A (-3.5)": "spread", "A (-3.5)": "spread", "A winner?": "moneyline_winner",
        "Will A win the 2026 NBA MVP award": "moneyline_winner", "Both teams to score": "btts", "Will A defeat B": "moneyline_winner", "over 3 or under 4": "totals", "rain": None,
    }
    assert one(spark, list(cases), "string", templates.sports_kind) == list(cases.values())
