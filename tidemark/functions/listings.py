"""What listings of different venues are about: teams, races, people, kinds of market. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match
from .text import jaccard

# ---- sports

# Kinds of sports market by their titles.
BUCKETS = (
    (r"\b(?:match\s+)?(?:to\s+)?end\s+in\s+(?:a\s+)?draw\b", "moneyline_winner"),
    (r"\bwill\s+.+\s+end\s+in\s+(?:a\s+)?draw\b", "moneyline_winner"),
    (r"\b(win|winner|match\s+winner|first\s+half\s+winner|1st\s+half\s+winner|halftime\s+winner)\b", "moneyline_winner"),
    (r"\bfirst\s+\d+\s+innings?\s+runs?\b", "totals"),
    (r"\b\d+(?:st|nd|rd|th)\s+innings?\s+runs?\b", "totals"),
    (r"\b(over|under)\s+\d+(?:\.\d+)?\s+runs?\b", "totals"),
    (r"\b(totals|over\/under|o\/u\s*[\d.]+)\b", "totals"),
    (r"\b(over|under)\s+[\d.]+\s+runs\b", "totals"),
    (r"\bwins by over\s+[\d.]+\s+runs\b", "totals"),
    (r"\b(both\s+teams?\s+to\s+score|btts)\b", "btts"),
    (r"\b(handicap|spread|[+-]\d+\.5)\b", "spread"),
)
# The vocabulary's names of those kinds.
TEMPLATES = {"moneyline_winner": "sports-moneyline", "totals": "sports-total", "spread": "sports-spread", "btts": "sports-yes-no"}
# Words of club names that tell no club from another.
CLUB_WORDS = "fc cf sc afc club team".split()


def team(name: Column) -> Column:
    """A team's name in lower-case letters and digits, without words that any club may have."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\bsaudi\s+club\b", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), rf"\b({'|'.join(CLUB_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def same_team(a: Column, b: Column) -> Column:
    return (team(a) != "") & (team(a) == team(b))


def similar_team(a: Column, b: Column) -> Column:
    """Equal, one within the other, or 0.35 of their words of two letters or more in common."""
    x, y = team(a), team(b)
    long = lambda t: F.filter(F.split(t, " "), lambda w: F.length(w) > 1)
    words = (F.size(long(x)) > 0) & (F.size(long(y)) > 0) & (jaccard(long(x), long(y)) >= 0.35)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | words)


def is_matchup(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(r"\bvs\.?\b| @ | at (?!(?:least|most|once|all|any|the |a ))"), F.lit(False))


def bucket(title: Column) -> Column:
    return first_match(F.lower(F.coalesce(title, F.lit(""))), BUCKETS)


def bucket_template(title: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv)), F.coalesce(bucket(title), F.lit("")))


def matchup_key(home: Column, away: Column) -> Column:
    """The two teams in either order; 'unknown' where one is missing."""
    h, a = team(home), team(away)
    return F.when((h == "") | (a == ""), "unknown").otherwise(F.array_join(F.array_sort(F.array(h, a)), "|"))


def sports_pair_fault(sport_a: Column, sport_b: Column, days: Column, key_a: Column, key_b: Column) -> Column:
    """Why two listings can't be of one game; null if they can. days: between their dates, null if unknown."""
    unknown = lambda s: s.isNull() | s.isin("", "unknown")
    return (
        F.when(unknown(sport_a) | unknown(sport_b), "sport_unknown").when(sport_a != sport_b, "sport_mismatch").when(days > 1, "game_date_delta_gt_1")
        .when((key_a == "unknown") | (key_b == "unknown"), "missing_matchup").when(key_a != key_b, "matchup_mismatch")
    )


def sports_attachment(event_home: Column, event_away: Column, home: Column, away: Column, days: Column, unknown_sport: Column) -> Column:
    """How well a listing fits a game, by teams (in either order) and days between; unknown_sport lowers similar names."""
    missing = F.greatest(*((team(x) == "").cast("int") for x in (event_home, event_away, home, away))) == 1
    either = lambda f: (f(home, event_home) & f(away, event_away)) | (f(home, event_away) & f(away, event_home))
    exact, similar = either(same_team), either(similar_team)
    return (
        F.when(missing, 0.0).when(~exact & ~similar, 0.08).when(days.isNull(), 0.12).when(days > 1, 0.25)
        .when(exact, F.when(days == 0, 1.0).otherwise(0.92)).when(unknown_sport, 0.6).when(days == 0, 0.9).otherwise(0.7)
    )


# ---- people and races

# Words that stand for others, words and endings that names go without.
SYNONYMS = {
    "gop": "republican", "dem": "democratic", "democrat": "democratic", "democrats": "democratic", "republicans": "republican", "pm": "prime minister", "sen": "senator",
    "gov": "governor", "rep": "representative", "pres": "president", "atty": "attorney", "ag": "attorney general",
}
NAME_STOPWORDS = "will be the a an for to of in on at by as nominee nomination presidential democratic republican party win election primary".split()


def with_synonyms(title: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    low = F.lower(F.coalesce(title, F.lit("")))
    words, between = F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)), F.split(low, r"\w+", -1)
    put = F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w))
    pairs = F.zip_with(between, F.concat(put, F.array(F.lit(""))), lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    return F.array_join(pairs, "")


def entity(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s-]", " ")
    plain = F.regexp_replace(plain, r"\s+(jr\.?|sr\.?|ii|iii|iv|v)\s*$", "")
    stop = F.array(*(F.lit(w) for w in NAME_STOPWORDS))
    return F.array_join(F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), " ")


def race_tokens(text: Column) -> Column:
    """Districts (ga14), senate races (senate-nv) and house races (house-az) that a text names."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "#", " ")

    def found(pattern: str, groups: int, prefix: str) -> Column:
        each = [F.regexp_extract_all(plain, F.lit(f"(?i){pattern}"), F.lit(g)) for g in range(1, groups + 1)]
        flat = F.filter(F.flatten(F.array(*each)), lambda s: F.length(s) == 2)
        return F.transform(flat, lambda s: F.concat(F.lit(prefix), F.lower(s)))

    d = r"\b([A-Za-z]{2})-?(\d{1,2})\b"
    districts = F.zip_with(F.regexp_extract_all(plain, F.lit(d), F.lit(1)), F.regexp_extract_all(plain, F.lit(d), F.lit(2)), lambda s, n: F.concat(F.lower(s), n))
    senate = found(r"senate\s+([A-Za-z]{2})\b|\b([A-Za-z]{2})\s+senate\s+(?:race|seat|election)", 2, "senate-")
    house = found(r"house\s+([A-Za-z]{2})\b|(?:house\s+)?([A-Za-z]{2})\s*\d|\b([A-Za-z]{2})-?\d{1,2}\s*(?:house|district)", 3, "house-")
    return F.array_distinct(F.concat(districts, senate, house))


def is_placeholder(outcome: Column) -> Column:
    """Missing, a number, or yes or no."""
    return outcome.isNull() | F.trim(outcome).rlike(r"(?i)^(\d+|(yes|no)(\s+\d+)?)?$")


def same_entity(a: Column, b: Column, races_a: Column, races_b: Column) -> Column:
    """Whether two names (as entity() writes them) may be one: a race in common, one last name, half of the words, a word
    and the last name's first two letters, or the first four letters."""
    last = lambda e: F.element_at(F.split(e, " "), -1)
    words = lambda e: F.filter(F.split(e, " "), lambda w: F.length(w) > 1)
    shared = F.size(F.array_intersect(words(a), words(b)))
    near = (jaccard(words(a), words(b)) >= 0.5) | ((shared >= 1) & (F.substring(last(a), 1, 2) == F.substring(last(b), 1, 2)))
    starts = F.startswith(a, F.substring(b, 1, 4)) | F.startswith(b, F.substring(a, 1, 4))
    return (
        F.when(F.size(F.array_intersect(races_a, races_b)) > 0, True).when((a == "") & (b == ""), True)
        .when((a == "") | (b == ""), False).otherwise((last(a) == last(b)) | near | starts)
    )


# What an outcome is, and which phase of an election it is about.
PHASES = (
    (r"\b(primary|nominee|nomination|first round|round 1)\b", "primary_or_nominee"),
    (r"\b(runoff|second round|round 2)\b", "runoff"),
    (r"\b(general|winner|wins|win the|election winner|governor race winner)\b", "general_or_winner"),
)


def outcome_kind(ref: Column, title: Column) -> Column:
    text = F.concat_ws(" ", F.lower(ref), F.lower(title))
    return (
        F.when(ref.rlike(r"(?i)#[ ]*(yes|no)$"), "binary_yesno").when(text.rlike(r"\b(democrat|democratic|republican|gop|party)\b"), "party")
        .when(F.contains(ref, F.lit("#")), "candidate").otherwise("unknown")
    )


def phase(ref: Column, title: Column) -> Column:
    return first_match(F.concat_ws(" ", F.lower(ref), F.lower(title)), PHASES, "unknown")


def guard_fault(block: Column, kind_a: Column, kind_b: Column, phase_a: Column, phase_b: Column) -> Column:
    """Why two listings of an election block must not be matched; null if they may."""
    ways = lambda x, y, p, q: ((x == p) & (y == q)) | ((x == q) & (y == p))
    applies = F.lower(F.coalesce(block, F.lit(""))).rlike("^(governor_|pres_|nominee)")
    return F.when(
        applies,
        F.when(ways(kind_a, kind_b, "party", "binary_yesno"), "semantic_guard_party_vs_binary_yesno")
        .when(ways(phase_a, phase_b, "primary_or_nominee", "general_or_winner"), "semantic_guard_phase_primary_vs_general")
        .when(ways(phase_a, phase_b, "runoff", "general_or_winner"), "semantic_guard_phase_runoff_vs_general"),
    )
