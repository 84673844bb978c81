"""Fixtures from matchups' titles, and the sport of listings: composed titles whose teams and sport are known, so the SQL
shares no pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matchups, sports
from .domain import domain

#: Titles of two teams ({a} away, {h} at home); whether they name both.
TITLES = (
    ("{a} vs {h}", True), ("{a} vs. {h} Winner?", True), ("{a} at {h}: First Half Winner?", True), ("{a} @ {h} first 5 innings runs?", True), ("Will {a} vs {h} end in a draw?", True),
    ("{a} Winner? vs {h} Winner?", True), ("{a} vs {h}: Quarterfinal match", True), ("{a} vs {h} O/U 8.5", True), ("{a} vs {h} Spread: -3", True), ("{a} vs {h} Both Teams to Score", True),
    ("{a} vs {h} Total Runs (F5)? moneyline", True), ("Will {a} win the {h} vs Others : Final", False), ("{a} to win at least twice", False), ("{a}", False),
)
TEAMS = ("Ducks", "Kings", "Oakland A's", "Red Sox", "St. Louis", "Inter Miami CF", "New York M", "Real Sociedad")
#: Title, ticker of the series, tags, tag number, reference, and the sport that they tell.
SIGNS = (
    ("Pro football: who wins?", None, None, None, None, "nfl"), ("Final game", "KXLOLGAME", None, None, None, "esports"), ("Season opener", "KXKHLGAME", None, None, None, "hockey"),
    ("Champions League final", None, "sports", None, None, "soccer"), ("Something", None, "wwoh", None, None, "nhl"), ("Wimbledon final", None, "itsb", None, None, "tennis"),
    ("Something", None, "foo,678", None, None, "mlb"), ("Something", None, "foo", "100350", None, "soccer"), ("Something", None, "bkjpn", None, "spl-a-b-2026", "soccer"),
    ("Something", None, "college-football", None, None, "soccer"), ("Something", None, None, None, "nhl-sj-wpg", "nhl"), ("Saudi Pro League: A vs B", None, None, None, None, "soccer"),
    ("Will it rain?", None, "weather", None, "kx-1", "unknown"), ("", None, None, None, None, "unknown"), (None, "KXNBAGAME", None, None, None, "unknown"),
)
SIGNS = tuple(s if s[2] != "college-football" else (*s[:5], "ncaaf") for s in SIGNS)


def _one_of(values: tuple, place: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(place, F.lit(len(values))).cast("int"))


def matchup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain(spark, sf_dir, "markets").select("market_id", F.lower("sport").alias("sport"), "game_day")
    i = F.col("market_id")
    away, home = _one_of(TEAMS, i), _one_of(TEAMS, i + 1 + F.floor(i / 8) % (len(TEAMS) - 1))
    title = F.replace(F.replace(_one_of(tuple(t for t, _ in TITLES), F.floor(i / 3)), F.lit("{a}"), away), F.lit("{h}"), home)
    return m.select("market_id", "sport", "game_day", title.alias("title"))


def matchup_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teams of each title; null where it names no two."""
    rows = matchup_titles(spark, sf_dir).withColumn("t", matchups.teams(F.col("title")))
    return rows.select("market_id", F.col("t.away").alias("away"), F.col("t.home").alias("home"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games that listings name, one for each sport, day and pair of cleaned teams, with the listings of each.

    Equal titles are counted first; cleaned teams are then counted again, since several titles name one game."""
    rows = matchup_titles(spark, sf_dir).where("game_day IS NOT NULL AND sport IN ('mlb', 'nba', 'nhl', 'soccer', 'mls', 'epl')")
    rows = rows.groupBy("sport", "game_day", "title").agg(F.count(F.lit(1)).alias("n"), F.min("market_id").alias("first"))
    rows = rows.withColumn("t", matchups.teams(F.col("title"))).where("t IS NOT NULL").select("sport", "game_day", "t.away", "t.home", "n", "first")
    games = rows.groupBy("sport", "game_day", F.lower("away").alias("a"), F.lower("home").alias("h"))
    games = games.agg(F.sum("n").alias("listings"), F.min_by(F.struct("away", "home"), "first").alias("names"))
    return games.select("sport", "game_day", F.concat("names.away", F.lit(" @ "), "names.home").alias("title"), "listings")


_LIST = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + str(x).replace("'", "''") + "'" for x in xs) + "]"
_NAMED = f"""WITH t AS (SELECT market_id, lower(sport) AS sport, game_day, list_extract({_LIST(TEAMS)}, market_id % {len(TEAMS)} + 1) AS a,
  list_extract({_LIST(TEAMS)}, (market_id + 1 + (market_id // 8) % {len(TEAMS) - 1}) % {len(TEAMS)} + 1) AS h, list_extract([{", ".join(str(y).lower() for _, y in TITLES)}], (market_id // 3) % {len(TITLES)} + 1) AS both_named FROM markets)
"""
MATCHUP_TEAMS = _NAMED + "SELECT market_id, CASE WHEN both_named THEN a END AS away, CASE WHEN both_named THEN h END AS home FROM t"
FIXTURES = _NAMED + """SELECT sport, game_day, concat(a, ' @ ', h) AS title, count(*) AS listings FROM t WHERE both_named AND game_day IS NOT NULL AND sport IN ('mlb', 'nba', 'nhl', 'soccer', 'mls', 'epl') GROUP BY sport, game_day, a, h"""


def told_sports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_id, old sport, and the sport that a listing's title, series, tags and references tell."""
    m = domain(spark, sf_dir, "markets").select("market_id", F.col("sport").alias("old"))
    sign = lambda k: _one_of(tuple(s[k] for s in SIGNS), F.floor(F.col("market_id") / 2))
    m = m.select("*", sign(0).alias("title"), sign(1).alias("series"), F.split(sign(2), ",").alias("tags"), sign(3).alias("tag_id"), sign(4).alias("ref"))
    by_venue = F.when(F.col("series").isNotNull(), sports.by_title(F.col("title"), F.col("series"))).otherwise(sports.sport(F.col("tags"), F.col("title"), F.col("tag_id"), F.col("ref"), F.lit(None).cast("string")))
    return m.select("market_id", "old", by_venue.alias("sport"))


def sports_retold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of no known sport whose sport can be told: what would be written."""
    return told_sports(spark, sf_dir).where("coalesce(old, 'unknown') = 'unknown' AND sport <> 'unknown'").select("market_id", "sport")


def sports_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings of each old sport stay without one, or change."""
    rows = told_sports(spark, sf_dir).withColumn("old", F.coalesce("old", F.lit("unknown")))
    return rows.groupBy("old").agg(F.count_if(F.col("sport") == "unknown").alias("left_unknown"), F.count_if(F.col("sport") != F.col("old")).alias("differ"))


_TOLD = f"WITH t AS (SELECT market_id, coalesce(sport, 'unknown') AS old, list_extract({_LIST(s[5] for s in SIGNS)}, (market_id // 2) % {len(SIGNS)} + 1) AS sport FROM markets)\n"
SPORTS_RETOLD = _TOLD + "SELECT market_id, sport FROM t WHERE old = 'unknown' AND sport <> 'unknown'"
SPORTS_LEFT = _TOLD + "SELECT old, count(*) FILTER (WHERE sport = 'unknown') AS left_unknown, count(*) FILTER (WHERE sport <> old) AS differ FROM t GROUP BY 1"

QUERIES = {
    "matchup_teams": (matchup_teams, MATCHUP_TEAMS),
    "fixtures": (fixtures, FIXTURES),
    "sports_retold": (sports_retold, SPORTS_RETOLD),
    "sports_left": (sports_left, SPORTS_LEFT),
}
