"""Text and set similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count in keyword overlap.
KEYWORDS = (
    "fed chair nominee ban tariff meet putin zelenskyy shutdown nuclear deal senate house election presidential democratic republican primary 2028 2026 governor congress impeachment"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and hyphens, one hyphen at either end cut off, of two characters or more."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^-|-$", "")), lambda w: F.length(w) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def keyword_overlap(a: Column, b: Column) -> Column:
    known = F.array(*(F.lit(w) for w in KEYWORDS))
    return jaccard(F.array_intersect(a, known), F.array_intersect(b, known))


def entity_overlap(a: Column, b: Column) -> Column:
    """Null if either is empty, 0 for none in common, 1 where one holds all of the smaller, else 0.5."""
    long = lambda x: F.array_distinct(F.filter(x, lambda t: F.length(t) > 1))
    x, y = long(a), long(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(None)).when(both == 0, 0.0).when(both == F.least(F.size(x), F.size(y)), 1.0).otherwise(0.5)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length, pairs with a null, NaN or infinite number left out; null where a norm is 0."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a.cast("array<double>"), 1, n).alias("x"), F.slice(b.cast("array<double>"), 1, n).alias("y"))
    pairs = F.filter(pairs, lambda p: fine(p["x"]) & fine(p["y"]))
    dot = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["x"] * p["y"])
    na = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["x"] * p["x"])
    nb = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["y"] * p["y"])
    return F.when((n > 0) & (na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb)))


def vector(a: Column) -> Column:
    """A vector with what its cosines need of it alone: v, squares (their sum) and whole (no null, NaN or infinite number)."""
    v = a.cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.struct(v.alias("v"), squares.alias("squares"), F.coalesce(F.forall(v, fine), F.lit(False)).alias("whole"))


def cosine_of(a: Column, b: Column) -> Column:
    """cosine() of two vector()s: of whole ones of one length only the products are added up here."""
    dot = F.aggregate(F.zip_with(a["v"], b["v"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    quick = F.when((a["squares"] > 0) & (b["squares"] > 0), dot / (F.sqrt(a["squares"]) * F.sqrt(b["squares"])))
    return F.when(a["whole"] & b["whole"] & (F.size(a["v"]) == F.size(b["v"])), quick).otherwise(cosine(a["v"], b["v"]))


def trigrams(text: Column) -> Column:
    """The distinct three-letter parts of the words of letters and digits, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    parts = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def parse_vector(text: Column) -> Column:
    """The finite numbers of a bracketed list; null if it is none."""
    parts = F.split(F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1), ",")
    numbers = F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(numbers) > 0, numbers)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# What a title, slug or reference is about; the first pattern that is found decides.
TOPICS = (
    (r"^govparty-([a-z]{2})-(\d{4})", "governor"),
    (r"^senate-([a-z]{2})-(\d{4})", "senate"),
    (r"fed\s*chair|chair\s*fed|federal\s*reserve\s*chair|powell\s*(leave|stay|chair)", "fed_chair"),
    (r"government\s*shutdown|shutdown\s*government", "shutdown"),
    (r"supreme\s*court|scotus", "supreme_court"),
    (r"nuclear\s*deal|iran\s*nuclear|nuclear\s*agreement", "nuclear_deal"),
    (r"impeach(ment)?", "impeachment"),
    (r"trump\s*banned|banned\s*on\s*x|x\s*ban|twitter\s*ban", "x_ban"),
    (r"trump\s*nominate|nominate\s*fbi|fbi\s*director|appointments?|cabinet\s*(pick|nominee)", "appointments"),
    (r"russia\s*deal|venezuela|turkey\s*election|international|ukraine|zelenskyy|putin\s*meet", "international"),
    (r"tariffs?|trade\s*war|china\s*tariff", "tariffs"),
    (r"tax\s*(cut|reform|plan)", "tax"),
    (r"trump\s*(zelenskyy|putin|meet|meeting)|meeting\s*(putin|zelenskyy)", "meetings"),
    (r"harvard\s*apps?|education\s*politics|college\s*admission", "education"),
    (r"presidential\s*nominee|nominee\s*2028|nomination\s*20\d{2}|democratic\s*nominee|republican\s*nominee", "nominee"),
    (r"senate\s*(race|election|seat|control)|control\s*of\s*senate|senate\s*(nv|az|mi|ga|pa|oh|wi|fl)", "senate"),
    (r"house\s*(race|election|seat|control)|control\s*of\s*the\s*house|house\s*(nv|az|mi|ga|pa|district)", "house"),
    (r"governor\s*(race|election)|gubernatorial", "governor"),
    (r"congress(ional)?\s*(election|control)", "congress"),
    (r"presidential\s*election|election\s*20\d{2}|president\s*20\d{2}|primary\s*20\d{2}", "election"),
)


def topic(text: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(TOPICS):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


# Fixed value: words of listings that are about a nominee, whatever else they name.
NOMINEE = r"\b(nominee|primary|presidential|2028)\b"


def topic_of(title: Column, ref: Column) -> Column:
    """The topic of a listing by its title and reference; one that is about a nominee is of that topic before all others."""
    told = F.regexp_replace(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(ref, F.lit(""))), "#", " ")
    return F.when(told.rlike(f"(?i){NOMINEE}"), "nominee").otherwise(topic(told))
