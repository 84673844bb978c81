"""Which race an election listing is about, as one signature: office, place, year. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States and their codes, the names of two words first.
STATES = {
    "west virginia": "wv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "south carolina": "sc",
    "south dakota": "sd", "rhode island": "ri", "district of columbia": "dc", "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}
# Codes that are also words.
AMBIGUOUS = ("in", "or", "me", "al", "hi", "de", "ok")
DEFAULT_YEAR, NOMINEE_YEAR = "2026", "2028"


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern's group holds; null where the pattern or the group is not there."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def state_code(text: Column) -> Column:
    """A state by its name, else by its code within 40 characters of an office's name."""
    low = F.lower(text)
    named = F.coalesce(*(F.when(F.contains(low, F.lit(name)), code) for name, code in STATES.items()))
    office = r"\b(?:senate|house|governor|gubernatorial|race|election)\b"
    clear = sorted(set(STATES.values()) - set(AMBIGUOUS))
    codes = rf"\b({'|'.join(clear)})\b"
    return F.coalesce(named, _one(low, rf"{office}.{{0,40}}?{codes}"), _one(low, rf"{codes}.{{0,40}}?{office}"))


def topic_key(key: Column) -> Column:
    """gov_oh_2026 and gov_ohio_2026 are governor_oh_2026; 'other' where there is none."""
    low = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    place = _one(low, r"^gov_([a-z_]+)_\d{4}(?:_special)?$")
    code = F.when(F.length(place) == 2, place).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.regexp_replace(place, "_", " ")))
    named = F.concat(F.lit("governor_"), code, F.lit("_"), _one(low, r"_(\d{4}(?:_special)?)$"))
    return F.when(low == "", "other").otherwise(F.coalesce(named, low))


def race_signature(ref: Column, title: Column) -> Column:
    """office_place_year, _special where the race is; null for what is no race."""
    ref, title = F.coalesce(ref, F.lit("")), F.coalesce(title, F.lit(""))
    text = F.lower(F.regexp_replace(F.concat_ws(" ", title, ref), "[#-]", " "))
    special = F.when(text.rlike(r"\bspecial\s*(election|race)?\b"), "_special").otherwise("")
    year = _one(text, r"\b(2024|2026|2028)\b")
    sign = lambda office, place, y: F.concat(F.lit(f"{office}_"), place, F.lit("_"), y, special)
    by_default, state = F.coalesce(year, F.lit(DEFAULT_YEAR)), state_code(text)

    def ticker(office: str, word: str) -> list[Column]:
        """From tickers such as WORD-OH-2026 and WORDOH-26."""
        full, short = rf"(?i)^{word}-([a-z]{{2}})-(\d{{4}})", rf"(?i)^{word}([a-z]{{2}})-(\d{{2}})(?:-|$)"
        return [sign(office, F.lower(_one(ref, full)), _one(ref, full, 2)), sign(office, F.lower(_one(ref, short)), F.concat(F.lit("20"), _one(ref, short, 2)))]

    district = r"(?i)^HOUSE-([a-z]{2})-(\d{1,2})-(\d{4})"
    numbered = r"\b([a-z]{2}) ?(\d{1,2})(?:st|nd|rd|th)?\b"
    known = F.when(_one(text, numbered).isin(*STATES.values()), F.concat(_one(text, numbered), _one(text, numbered, 2)))
    ordinal = F.concat(state, _one(text, r"\b(\d{1,2})(?:st|nd|rd|th)\s+district\b"))
    slug = F.split(F.lower(F.regexp_replace(F.split_part(ref, F.lit("#"), F.lit(1)), "-", " ")), r"\s+")
    at = F.array_position(slug, "mayor")
    city = F.when(at > 1, F.slice(slug, 1, F.least(at - 1, F.lit(2)).cast("int"))).otherwise(F.slice(F.filter(slug, lambda w: (w != "mayor") & (F.length(w) > 1)), 1, 2))
    return F.coalesce(
        *ticker("governor", "GOVPARTY"), *ticker("senate", "SENATE"), sign("house", F.concat(F.lower(_one(ref, district)), _one(ref, district, 2)), _one(ref, district, 3)),
        F.when(text.rlike(r"\b(governor|gubernatorial|govparty)\b"), sign("governor", F.coalesce(state, F.lit("unknown")), by_default)),
        F.when(text.rlike(r"\bsenate\b"), sign("senate", state, by_default)),
        F.when(text.rlike(r"\b(presidential\s*(nominee|primary)|nominee\s*2028|(democratic|republican)\s*nominee)\b"), F.concat(F.lit("pres_nominee_us_"), F.coalesce(year, F.lit(NOMINEE_YEAR)))),
        F.when(text.rlike(r"\bhouse\b"), sign("house", F.coalesce(ordinal, known), by_default)),
        F.when(text.rlike(r"house\s*(race|election|seat)"), sign("house", state, by_default)),
        F.when(text.rlike(r"\bmayor\b"), sign("mayor", F.coalesce(F.nullif(F.array_join(city, "_"), F.lit("")), F.lit("unknown")), by_default)),
        F.when(text.rlike(r"\bcongress(ional)?\s*(election|control)\b"), sign("congress", F.lit("us"), by_default)),
    )
