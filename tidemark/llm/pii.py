"""PII by information-theoretic sanitisation, in DataFrame functions alone.

First the base spans (e-mail addresses, IP addresses, card and phone numbers). Then the corpus says what else gives them
away: an entity is a value found in at least `min_docs` documents, else its kind; a term (a run of letters) discloses the
entity e to the degree PMI(term; e) / IC(e), that is, by how much of the entity's information content the term's presence
tells (1: it occurs beside e alone). In documents with e, terms that disclose at least REMOVE of it are removed, those
that disclose at least GENERALISE are replaced by what kind of word they are.

Positions come from splitting a text at a pattern's matches: the lengths of what lies between and of the matches add up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import bound
from .common import written

#: Documents in which a value, or a term beside an entity, must occur before the corpus says anything of it.
MIN_DOCS = 5
#: Letters of a term at least.
MIN_LETTERS = 3
#: Columns that the operator adds or works with; a table's own columns of these names give way.
RESERVED = {"base", "terms", "sanitised", "degrees", "_key", "_text", "_pattern", "_hits", "_swaps", "_email", "_ip", "_card", "_phone"}
#: Shares of an entity's information content.
GENERALISE, REMOVE = 0.8, 0.95

KINDS = ("email", "ip", "card", "phone")
# The patterns asked for, in forms that match the same and neither recurse nor rescan a run: a run is
# entered at its start, or where the match before ended.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+ (of 16 digits at least)           phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){15})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _root(n: Column) -> Column:
    return F.ceil(F.sqrt(n)).cast("int")


def _stretches(items: Column) -> Column:
    """An array cut into about as many stretches as each has members. Folds that put arrays together copy what they have
    at each step; stretch by stretch they copy n to the power of 1.5 members in all, not the square of n."""
    return bound(items, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _root(F.size(x))).cast("int")), lambda i: F.slice(x, i * _root(F.size(x)) + 1, _root(F.size(x))))))


def positions(kind: str | Column, matches: Column, between: Column) -> Column:
    """The spans of all matches of a pattern, given them and what a split at the pattern leaves."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def stretch(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return bound(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(_stretches(pairs), begin, stretch, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    worths = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(worths, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (F.length(_digits(x)) <= 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def with_base_spans(rows: DataFrame, text: str = "text", to: str = "base") -> DataFrame:
    """Adds the base spans, by kind as listed, then by start."""
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    seen = rows.withColumns({
        f"_{k}": F.when(hint.get(k, F.lit(True)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()
    })
    spans = {
        f"_{k}": _kept(k, F.when(F.size(f"_{k}") > 0, positions(k, F.col(f"_{k}"), F.split(text, p, -1))).otherwise(F.array().cast(SPAN)))
        for k, p in PATTERNS.items()
    }
    return seen.withColumns(spans).withColumn(to, F.concat(*(f"_{k}" for k in KINDS))).drop(*spans)


def disclosures(found: DataFrame, docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(entity, term, degree, n_both, n_term, n_entity): terms that disclose at least GENERALISE of an entity.

    found: (key, text, base) of the rows with base spans; docs: the text of all rows. Counts are of rows, all of them."""
    total = docs.agg(F.count(F.lit(1)).alias("n_all"))
    letters = lambda df: F.filter(F.array_distinct(F.split(df[text], r"[^\p{L}]+")), lambda w: F.length(w) >= MIN_LETTERS)
    # As strings: different structs of an array are found by comparing all of them.
    told = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    values = found.select("key", F.explode(told).alias("e")).select("key", F.substring_index("e", ":", 1).alias("kind"), F.regexp_replace("e", "^[a-z]*:", "").alias("value"))
    often = values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    named = values.join(often, ["kind", "value"], "left")
    entities = named.select("key", F.when(F.col("n").isNotNull(), F.concat_ws(":", "kind", "value")).otherwise(F.col("kind")).alias("entity")).distinct()
    entities = written(entities, "entities")
    of = found.select("key", letters(found).alias("terms")).join(entities, "key")
    n_both = of.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    n_entity = found.select("key").join(entities, "key").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n_term = docs.select(F.explode(letters(docs)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    pairs = n_both.where(F.col("n_both") >= min_docs).join(n_entity, "entity").join(n_term, "term").crossJoin(F.broadcast(total))  # one row
    content = F.log(F.col("n_all") / F.col("n_entity"))
    pmi = F.log(F.col("n_both").cast("double") * F.col("n_all") / (F.col("n_term").cast("double") * F.col("n_entity")))
    degree = F.when(content > math.ulp(1.0), pmi / content)
    return pairs.withColumn("degree", degree).where(F.col("degree") >= GENERALISE).select("entity", "term", "degree", "n_both", "n_term", "n_entity")


def _general(term: Column) -> Column:
    return F.when(term.rlike(r"^\p{Lu}+$"), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[Name]").otherwise("[word]")


SWAP = "struct<start:int,is_term:int,end:int,by:string,term:string,degree:double>"
#: A place after all texts.
AFTER = 2**31 - 1


def _swaps(base: Column, hits: Column, degrees: Column) -> Column:
    """What is replaced, from left to right: base spans (of those that overlap, the first) and the terms that overlap none,
    by one walk over both in order of their starts. A term waits for the span after it, which may begin within it."""
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("is_term"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("degree")))
    terms = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("is_term"), t["end"].alias("end"), F.when(degrees[t["value"]] >= REMOVE, "").otherwise(_general(t["value"])).alias("by"), t["value"].alias("term"), degrees[t["value"]].alias("degree")))
    last = F.array(F.struct(F.lit(AFTER).alias("start"), F.lit(0).alias("is_term"), F.lit(AFTER).alias("end"), F.lit("").alias("by"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("degree")))
    none = F.lit(None).cast(SWAP)

    def step(acc: Column, x: Column) -> Column:
        is_base, wait = x["is_term"] == 0, acc["wait"]
        fine = wait.isNotNull() & (~is_base | (wait["end"] <= x["start"]))
        put = F.concat(acc["out"], F.when(fine, F.array(wait)).otherwise(F.array().cast(f"array<{SWAP}>")), F.when(is_base & (x["start"] >= acc["at"]), F.array(x)).otherwise(F.array().cast(f"array<{SWAP}>")))
        return F.struct(
            F.when(is_base & (x["start"] >= acc["at"]), x["end"]).otherwise(acc["at"]).alias("at"),
            F.when(is_base, F.greatest(acc["covered"], x["end"])).otherwise(acc["covered"]).alias("covered"),
            F.when(~is_base & (x["start"] >= acc["covered"]), x).otherwise(none).alias("wait"),
            put.alias("out"),
        )

    def stretch(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), acc["covered"].alias("covered"), acc["wait"].alias("wait"), F.array().cast(f"array<{SWAP}>").alias("out")), step)
        return bound(own, lambda r: F.struct(r["at"].alias("at"), r["covered"].alias("covered"), r["wait"].alias("wait"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("covered"), none.alias("wait"), F.array().cast(f"array<array<{SWAP}>>").alias("out"))
    done = F.aggregate(_stretches(F.array_sort(F.concat(spans, terms, last))), begin, stretch, lambda acc: F.flatten(acc["out"]))
    return F.filter(done, lambda s: s["start"] < AFTER)


def _sanitised(text: Column, swaps: Column) -> Column:
    """The text with its swaps made. They don't overlap; each stretch of them is cut out of the text first, so that no swap
    goes through the whole text."""

    def cut(xs: Column) -> Column:
        def one(part: Column, at: Column, own: Column) -> Column:
            before = lambda i: F.when(i == 0, at).otherwise(F.get(own, i - 1)["end"]) - at
            return F.array_join(F.transform(own, lambda s, i: F.concat(F.substring(part, before(i) + 1, s["start"] - at - before(i)), s["by"])), "")

        def stretch(own: Column, i: Column) -> Column:
            at = F.coalesce(F.element_at(F.get(xs, i - 1), -1)["end"], F.lit(0))
            part = F.substring(text, at + 1, F.element_at(own, -1)["end"] - at)
            return bound(part, lambda p: one(p, at, own))

        return F.array_join(F.transform(xs, stretch), "")

    end = F.coalesce(F.element_at(swaps, -1)["end"], F.lit(0))
    return F.when(F.size(swaps) == 0, text).otherwise(F.concat(bound(_stretches(swaps), cut), F.substring(text, end + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row and column of docs, with base (spans of the four kinds), terms (spans of disclosing terms, with degree)
    and sanitised, its text with base spans replaced by [KIND] and terms removed or generalised.

    A null text has no spans and stays null. Terms inside base spans belong to those. Repeated rows are each counted and
    each come back; null ids are allowed; other columns stay as they are, but those named in RESERVED are left out. An
    empty table gives an empty one. Rows without base spans never move; those with some are written once, then joined."""
    columns = [c for c in docs.columns if c not in RESERVED - {id_col, text_col}]
    docs = docs.select(*columns)
    rows = docs.withColumns({"_key": F.xxhash64(F.col(id_col), F.col(text_col)), "_text": F.coalesce(F.col(text_col), F.lit(""))})
    rows = with_base_spans(rows, "_text", "base")
    none = rows.where(F.size("base") == 0).select(*columns, "base", F.array().cast("array<struct<start:int,end:int,term:string,degree:double>>").alias("terms"), F.col(text_col).alias("sanitised"))

    found = written(rows.where(F.size("base") > 0), "found")
    pairs = written(disclosures(found.select(F.col("_key").alias("key"), F.col("_text").alias("text"), "base"), docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", min_docs), "disclosures")
    # Which rows hold which of the terms: by entity and term, never all terms of an entity against all its rows.
    once = found.dropDuplicates(["_key"])
    values = once.select(F.col("_key").alias("key"), "_text", F.explode(F.array_distinct(F.flatten(F.transform("base", lambda s: F.array(s["kind"], F.concat_ws(":", s["kind"], s["value"])))))).alias("entity"))
    kinds = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).select("entity")
    held = values.join(kinds, "entity").select("key", "entity", F.explode(F.filter(F.array_distinct(F.split("_text", r"[^\p{L}]+")), lambda w: F.length(w) >= MIN_LETTERS)).alias("term"))
    held = held.join(pairs.select("entity", "term", "degree"), ["entity", "term"])
    held = held.groupBy("key", "term").agg(F.max("degree").alias("degree")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "degree"))).alias("degrees"))

    joined = found.join(held.withColumnRenamed("key", "_key"), "_key", "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("degrees"), "|"), F.lit(r")(?!\p{L})"))
    joined = joined.withColumn("_pattern", pattern).withColumn("_hits", F.when(F.col("_pattern").isNotNull(), F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))))
    hits = positions("term", F.coalesce("_hits", F.array().cast("array<string>")), F.when(F.col("_pattern").isNotNull(), F.split("_text", F.col("_pattern"), -1)))
    joined = joined.withColumn("_swaps", _swaps(F.col("base"), hits, F.col("degrees")))
    terms = F.transform(F.filter("_swaps", lambda s: s["is_term"] == 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("term"), s["degree"].alias("degree")))
    some = joined.select(*columns, "base", terms.alias("terms"), _sanitised(F.col("_text"), F.col("_swaps")).alias("sanitised"))
    return none.unionByName(some)


def _told(kind: Column, s: Column) -> Column:
    return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))


def op3_pii_sanitise(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sanitise(docs)
    base = F.transform("base", lambda s: _told(s["kind"], s))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, F.transform("terms", lambda t: _told(F.lit("term"), t))), ",").alias("spans"),
    )
