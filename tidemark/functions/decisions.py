"""What is decided about a pair of two venues' election listings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import listings, money, text

# Least confidences of a pair that is looked at further, of an equivalent and of a proxy proposal, by what the
# block's name begins with; the last holds for all others.
LEAST = {"governor_": (0.25, 0.78, 0.60), "pres_": (0.40, 0.78, 0.70), "nominee": (0.40, 0.78, 0.70), "": (0.5, 0.92, 0.86)}
# From where a pair is accepted unseen (new, and attached to a family), and ceilings of what is proposed.
ACCEPT_NEW, ACCEPT_ATTACHED, BELOW_EQUIVALENT, BELOW_PROXY, MOST_PROXY_CONFIDENCE = 0.985, 0.92, 0.985, 0.98, 0.97
# Similarities of title and slug one of which an equivalent pair has; cosine that makes a proxy by itself.
LEAST_TITLE, LEAST_SLUG, LEAST_COSINE = 0.30, 0.20, 0.87
# Factor without a common word of the names, weight of the overlap, bonuses.
NO_OVERLAP, OVERLAP, SAME_RACE, GOVERNOR_PARTY, TOPIC, SOON, SOON_DAYS = 0.4, 0.3, 0.35, 0.35, 0.1, 0.05, 60
STRONG, WEAK = 1.0, 0.7
NO_RACE = ("other", "nominee")
#: What word_features says.
WORD_FEATURES = ("title", "slug", "same", "overlap", "last", "shared", "keywords", "one_race", "fault", "party")
#: What block_features says.
BLOCK_FEATURES = ("least", "least_equivalent", "least_proxy", "governor")


def _by_block(block: Column, place: int) -> Column:
    low, out = F.lower(F.coalesce(block, F.lit(""))), F.lit(LEAST[""][place])
    for start, values in LEAST.items():
        if start:
            out = F.when(F.startswith(low, F.lit(start)), values[place]).otherwise(out)
    return out


def block_features(block: Column) -> dict[str, Column]:
    """What a block's name says of its pairs: the least confidences, and whether it is a governor's race."""
    governor = F.startswith(F.lower(F.coalesce(block, F.lit(""))), F.lit("governor_"))
    return {name: _by_block(block, i) for i, name in enumerate(BLOCK_FEATURES[:3])} | {"governor": governor}


def traits(rows: DataFrame) -> DataFrame:
    """Adds what a listing's pairs are compared by, once for each listing. rows: title, ref, event_ref, entity (as
    listings.entity writes it), and what features reads as it is."""
    slug = F.replace(F.coalesce("event_ref", "ref", F.lit("")), F.lit("-"), F.lit(" "))
    entity = F.coalesce("entity", F.lit(""))
    told = F.concat_ws(" ", "ref", "title")
    by_party = F.lower(told).rlike(r"\b(democrat|republican|party)\b")
    return rows.withColumns({
        "t_title": text.tokens(F.col("title")), "t_slug": text.tokens(slug), "t_entity": entity, "t_races": listings.race_tokens(told),
        "t_words": F.filter(F.split(entity, " "), lambda w: F.length(w) > 1), "t_last": F.element_at(F.split(entity, " "), -1),
        "t_kind": listings.outcome_kind(F.col("ref"), F.col("title")), "t_phase": listings.phase(F.col("ref"), F.col("title")),
        "t_party": F.contains(F.lower(told), F.lit("govparty")) | by_party,
        "t_governor": F.contains(F.lower(told), F.lit("governor")) & F.lower(told).rlike(r"\b(democrat|republican|party|winner)\b"),
    })


def word_features(a: str, b: str) -> dict[str, Column]:
    """What a pair's words say, of its columns, prefixed a and b: the traits, topics (array) and race (signature). Nulls in a
    listing give the feature's least value, or null where unknown. A pair's dates (soon) and vectors (cosine) are apart."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    both = lambda c: (x(c), y(c))
    same = listings.same_entity(*both("t_entity"), *both("t_races"))
    return {
        "title": text.jaccard(*both("t_title")), "slug": text.jaccard(*both("t_slug")), "same": same,
        "overlap": F.coalesce(text.entity_overlap(*both("t_words")), F.when(same, 0.5).otherwise(0.0)),
        "last": (x("t_entity") != "") & (y("t_entity") != "") & (x("t_last") == y("t_last")),
        "shared": F.coalesce(F.size(F.array_intersect(*both("topics"))) > 0, F.lit(False)),
        "keywords": text.keyword_overlap(F.concat(x("t_title"), x("t_slug")), F.concat(y("t_title"), y("t_slug"))),
        "one_race": F.coalesce((x("race") == y("race")) & ~x("race").isin(*NO_RACE), F.lit(False)),
        "fault": listings.guard_fault(F.col("block"), *both("t_kind"), *both("t_phase")),
        "party": x("t_party") & y("t_governor"),
    }


def soon(a_close_us: Column, b_close_us: Column) -> Column:
    """Whether two listings close within so many days of each other; false where a time is not known."""
    return F.coalesce(F.abs(a_close_us - b_close_us) / 86_400_000_000 <= SOON_DAYS, F.lit(False))


def confidences(block: Column, f: dict[str, Column]) -> tuple[Column, Column]:
    """Of features: the confidences that the pair is equivalent, and that it is a proxy. Features may hold what block_features
    says, worked out before; else it is worked out of the block."""
    raw = money.pair_confidence(
        f["title"], f["slug"], F.lit(True), f["shared"], f["keywords"], F.when(f["last"], STRONG).otherwise(WEAK), F.lit(TOPIC), F.when(f["soon"], SOON).otherwise(0.0), f["cosine"]
    )
    equivalent = F.least(F.lit(1.0), raw["equivalent_confidence"] + F.when(f["one_race"] & f["last"], SAME_RACE).otherwise(0.0))
    added = f["overlap"] * OVERLAP
    none = f["overlap"] == 0
    equivalent = F.when(none, equivalent * NO_OVERLAP).otherwise(F.least(F.lit(1.0), equivalent + added))
    proxy = F.when(none, raw["proxy_confidence"] * NO_OVERLAP).otherwise(F.least(F.lit(MOST_PROXY_CONFIDENCE), raw["proxy_confidence"] + added))
    governor = (block_features(block) | f)["governor"]
    return equivalent, F.when(governor & f["party"], F.least(F.lit(MOST_PROXY_CONFIDENCE), proxy + GOVERNOR_PARTY)).otherwise(proxy)


def verdict(block: Column, f: dict[str, Column], equivalent: Column, proxy: Column, attach: Column, nameless: Column) -> Column:
    """(kind, confidence, reason): accepted, equivalent or proxy with its confidence, else skipped, and why. attach: the
    target is linked to a family; nameless: neither listing names anyone in particular."""
    least, least_equivalent, least_proxy = ((block_features(block) | f)[name] for name in BLOCK_FEATURES[:3])
    told = lambda kind, confidence, reason: F.struct(F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    no = lambda reason: told("skipped", F.lit(None), reason)
    return (
        F.when((equivalent < least) & (proxy < least), no("low_confidence"))
        .when(f["fault"].isNotNull(), no(f["fault"]))
        .when(equivalent >= F.when(attach, ACCEPT_ATTACHED).otherwise(ACCEPT_NEW), told("accepted", equivalent, F.when(attach, "attach_to_family").otherwise("new_pair")))
        .when(
            (equivalent >= least_equivalent) & (equivalent < BELOW_EQUIVALENT),
            F.when((money.half_up(f["title"], 4) < LEAST_TITLE) & (money.half_up(f["slug"], 4) < LEAST_SLUG), no("titles_differ")).otherwise(told("equivalent", equivalent, "confidence")),
        )
        .when(~nameless & (proxy >= least_proxy) & (proxy < BELOW_PROXY), told("proxy", proxy, "topic_or_entity_match"))
        .when((f["cosine"] >= LEAST_COSINE) & f["shared"], told("proxy", money.half_up(f["cosine"], 4), "embedding_cosine_gate"))
        .otherwise(no("low_confidence"))
    )
