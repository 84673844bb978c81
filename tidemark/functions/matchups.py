"""The two teams of a matchup's title, without what a title says besides, as column expressions.

A title is cut at the first rule that is found, again and again until none is: a fold over a bounded number of passes that
stands still once a pass has changed nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listings import is_matchup
from .rules import bound

# Ends of titles that name a kind of market; the first in this order that is found is cut off, up to
# TITLE_PASSES times.
TITLE_ENDS = (
    r"\s+first\s+\d+\s+innings?\s+runs?\??$",
    r"\s+first\s+\d+\s+innings?\??$",
    r"\s+first\s+inning\s+runs?\??$",
    r"\s+first\s+inning\s+run\??$",
    r"\s+first\s+inning\??$",
    r"\s+\d+(?:st|nd|rd|th)\s+innings?\s+runs?\??$",
    r"\s+\d+(?:st|nd|rd|th)\s+innings?\??$",
    r"\s+\d+(?:st|nd|rd|th)\s+quarter\b.*$",
    r"\s+\d+(?:st|nd|rd|th)\s+half\b.*$",
    r"\s+\d+(?:st|nd|rd|th)\s+period\b.*$",
    r"\s+first\s+half\b.*$",
    r"\s+second\s+half\b.*$",
    r"\s+first\s+quarter\b.*$",
    r"\s+second\s+quarter\b.*$",
    r"\s+third\s+quarter\b.*$",
    r"\s+fourth\s+quarter\b.*$",
    r"\s+both\s+teams?\s+to\s+score\b.*$",
    r"\s+btts\b.*$",
    r"\s+total\s+runs?\s*(?:\([^)]*\))?\??$",
    r"\s+total\s+(?:goals|points|score)\b.*$",
    r"\s+match\s+end\s+in\s+a\s+draw\??$",
    r"\s+end\s+in\s+a\s+draw\??$",
    r"\s+to\s+end\s+in\s+a\s+draw\??$",
    r"\s+moneyline\b.*$",
    r"\s+O\/U\s+[\d.]+\b.*$",
    r"\s+over\/under\b.*$",
    r"\s+over\s+[\d.]+\s+runs?\b.*$",
    r"\s+under\s+[\d.]+\s+runs?\b.*$",
    r"\s+wins?\s+by\s+over\s+[\d.]+\s+runs?\b.*$",
    r"\bspread\s*:\s*.*$",
    r"\s+\(-?\d+\.5\)\s*$",
    r"\s+spread\b.*$",
    r"\s+handicap\b.*$",
    r"\s*:\s*first\s+half\b.*$",
    r"\s*:\s*second\s+half\b.*$",
    r"\s*:\s*1st\s+half\b.*$",
    r"\s*:\s*2nd\s+half\b.*$",
    r"\s*:\s*(?:1st|2nd|3rd|4th)\s+quarter\b.*$",
    r"\s*:\s*first\s+quarter\b.*$",
    r"\s*:\s*second\s+quarter\b.*$",
    r"\s*:\s*third\s+quarter\b.*$",
    r"\s*:\s*fourth\s+quarter\b.*$",
    r"\s*:\s*quarterfinals?\b.*$",
    r"\s*:\s*semifinals?\b.*$",
    r"\s*:\s*final\b.*$",
    r"\s*:\s*round\s+of\s+\d+\b.*$",
    r"\s*:\s*first\s+\d+\s+innings?\b.*$",
    r"\s*:\s*first\s+inning\b.*$",
    r"\s*:\s*period\s+\d+\b.*$",
    r"\s*:\s*set\s+\d+\b.*$",
    r"\s+winner\??$",
    r"\s+runs\??$",
    r"\?\s*$",
)
# What is cut off a team, every one that is found, up to TEAM_PASSES times; the longest name.
TEAM_ENDS = (
    r"\s+winner\??$",
    r"\s+total\s+runs?\b.*$",
    r"\s+runs\??$",
    r"\s+moneyline\b.*$",
    r"\s+spread\b.*$",
    r"\s+O\/U\b.*$",
    r"\s*:\s*first\s+half\b.*$",
    r"\s*:\s*second\s+half\b.*$",
    r"\s*:\s*1st\s+half\b.*$",
    r"\s*:\s*2nd\s+half\b.*$",
    r"\s*:\s*(?:1st|2nd|3rd|4th)\s+quarter\b.*$",
    r"\s*:\s*first\s+quarter\b.*$",
    r"\s*:\s*second\s+quarter\b.*$",
    r"\s*:\s*third\s+quarter\b.*$",
    r"\s*:\s*fourth\s+quarter\b.*$",
    r"\s*:\s*quarterfinals?\b.*$",
    r"\s*:\s*semifinals?\b.*$",
    r"\s*:\s*final\b.*$",
    r"\s*:\s*round\s+of\s+\d+\b.*$",
    r"\s*:\s*first\s+\d+\s+innings?\b.*$",
    r"\s*:\s*first\s+inning\b.*$",
    r"\s*:\s*period\s+\d+\b.*$",
    r"\s*:\s*set\s+\d+\b.*$",
    r"\s*:\s*[A-Za-z][A-Za-z0-9 .\-']{2,}\s*match\??\s*$",
)
TITLE_PASSES, TEAM_PASSES, LONGEST_TEAM = 24, 12, 100
# Fixed value: what stands between two teams.
BETWEEN = r"^(.+?)\s+(?:vs\.?|@|at(?!\s+(?:least|most|once|all|any|the\b|a\b)))\s+(.+)$"


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _cut(text: Column, pattern: str, least: int) -> Column:
    """What stands before the pattern, if it is found at `least` or later; else null."""
    return bound(F.regexp_instr(text, F.lit(f"(?i){pattern}")), lambda at: F.when(at >= least, F.trim(F.substring(text, F.lit(1), at - 1))))


def _to_rest(text: Column, once: Callable[[Column], Column], passes: int) -> Column:
    """once(text) again and again until it changes nothing, `passes` times at most."""

    def step(acc: Column, _: Column) -> Column:
        going = bound(once(acc["text"]), lambda x: F.struct(x.alias("text"), (x == acc["text"]).alias("rests")))
        return F.when(acc["rests"], acc).otherwise(going)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(text.alias("text"), F.lit(False).alias("rests")), step, lambda acc: acc["text"])


def without_market(title: Column) -> Column:
    """A title without the kinds of market at its end."""
    first = lambda s: F.coalesce(*(_cut(s, p, 2) for p in TITLE_ENDS), s)
    return F.trim(F.regexp_replace(_to_rest(_one_line(title), first, TITLE_PASSES), r"[?:.,;]+$", ""))


def clean_team(name: Column) -> Column:
    """One side of a matchup without what says which market it is; empty where nothing is left."""

    def without(pattern: str) -> Callable[[Column], Column]:
        return lambda x: F.coalesce(_cut(x, pattern, 1), x)

    def each(s: Column) -> Column:
        for pattern in TEAM_ENDS:
            s = bound(s, without(pattern))
        return F.trim(F.regexp_replace(s, r"^[?.:;,]+|[?.:;,]+$", ""))

    return F.substring(_to_rest(_one_line(name), each, TEAM_PASSES), 1, LONGEST_TEAM)


def teams(title: Column) -> Column:
    """(away, home) of a title that looks like a matchup, both null where it names no two teams; of a question whether
    someone wins the whole, too."""

    def split(cleaned: Column) -> Column:
        asked = F.nullif(F.regexp_extract(cleaned, r"(?i)^will\s+(.+)", 1), F.lit(""))
        rest = F.when(F.coalesce(asked.rlike(r"(?i)\bwins?\s+the\b"), F.lit(False)), "").otherwise(F.coalesce(F.trim(asked), cleaned))

        def sides(s: Column) -> Column:
            part = lambda i: clean_team(F.trim(F.regexp_replace(F.trim(F.regexp_extract(s, f"(?i){BETWEEN}", i)), r"^[?.:;,]+|[?.:;,]+$", "")))
            return F.struct(part(1).alias("away"), part(2).alias("home"))

        return bound(bound(rest, sides), lambda t: F.when((t["away"] != "") & (t["home"] != ""), t))

    return F.when(is_matchup(title), bound(without_market(title), split))
