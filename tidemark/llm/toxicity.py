"""Toxicity by weak supervision.

1. A lexicon: of all rows whose labels may be learnt from, the words and word beginnings that toxic texts have far more
   often than clean ones.
2. Voters: each holds a share of the lexicon or a pattern of the text's form, and votes toxic, clean or not at all.
3. A generative label model over all texts, labelled or not: a vote depends on the label and on the vote of one other
   voter, that with which it goes together most given the label (a tree of voters). Expectation-maximisation, begun with
   the rows whose labels may be learnt from, estimates these probabilities, so accuracies and correlations in one: a voter
   that repeats another adds little. It gives each text a posterior label.
4. A linear classifier over the lexicon entries and patterns, fitted to the posterior labels, scores every text.

Steps 1 to 3 read every row; each step of the expectation-maximisation adds up one vote pattern's rows at a time."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import written

#: Rows that the classifier is fitted to, about, at most: a sample, drawn in proportion to how often a pattern occurs.
FITTED_ROWS = 40_000
#: Entries of the lexicon (the classifier's size), the share of toxic rows, and the rows, that each must occur in, how much
#: likelier toxic rows must have it, and what is added to the share of clean rows for that.
ENTRIES, LEAST_SHARE, LEAST_ROWS, LEAST_ODDS, SMOOTHING = 300, 0.015, 4, 150.0, 3e-5
#: Letters of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: The best words, and the best beginnings, are voters of their own; the rest share voters, the worse the more.
ALONE, SHARED = 16, 5
WORD_VOTERS = BEGINNING_VOTERS = ALONE + SHARED
STEPS = 12
#: Two voters go together where the label leaves so much mutual information (nats) between them.
TOGETHER = 1e-4
WORD = re.compile(r"[^\W\d_]+")
FORMS = {"shouting": None, "exclaiming": re.compile("!!"), "drawn out": re.compile(r"([^\W\d_])\1{3}"), "masked": re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]")}
CLEAN, TOXIC, NOTHING = 0, 1, 2
#: Bits of the map of labelled ids (8 MB at most, by 2^15 in a row), by which texts stay that have no label.
ID_BITS = 26


@dataclass
class Lexicon:
    """Entry -> number, best first. A beginning is written with an asterisk, one of several words with two."""

    entries: dict[str, int]

    def voters(self) -> dict[int, int]:
        """The voter of each entry, by its place among the words or among the beginnings."""
        out, seen = {}, [0, 0]
        for entry, i in self.entries.items():
            kind = entry.endswith("*")
            place = seen[kind]
            seen[kind] += 1
            shared = ALONE + min(SHARED - 1, max(place - ALONE, 0).bit_length() // 2)
            out[i] = WORD_VOTERS * kind + (place if place < ALONE else shared)
        return out


def grams_of(words: set[str]) -> set[str]:
    """The words, their beginnings, and the beginnings that two or more of them share."""
    out = set(words)
    for n in BEGINNINGS:
        counts = Counter([w[:n] for w in words if len(w) > n])
        out.update([b + "*" for b in counts])
        out.update([b + "**" for b, k in counts.items() if k > 1])
    return out


def forms_of(text: str, words: list[str]) -> list[int]:
    """What a text's form votes."""
    if not words:
        return [NOTHING] * len(FORMS)
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
    return [TOXIC if (p.search(text) if p else 5 * shouted > len(words)) else NOTHING for p in FORMS.values()]


class Reader:
    """What a text holds of a lexicon, and how the voters vote."""

    def __init__(self, lexicon: Lexicon):
        self.entries = lexicon.entries
        self.voter = lexicon.voters()
        self.lengths = sorted({len(e.rstrip("*")) for e in lexicon.entries if e.endswith("*")})
        self.beginnings = {e.rstrip("*") for e in lexicon.entries if e.endswith("*")}
        self.voters = WORD_VOTERS + BEGINNING_VOTERS + len(FORMS) + 1
        self.features = len(lexicon.entries) + len(FORMS) + 1

    def read(self, text: str) -> tuple[bytes, list[int]]:
        """The votes, one byte each, and the numbers of the features it has."""
        words, known = WORD.findall(text), self.entries
        once = {w.lower() for w in words}
        held = [known[w] for w in once if w in known]
        for n in self.lengths:
            counts = Counter([b for w in once if len(w) > n and (b := w[:n]) in self.beginnings])
            held += [known[e] for b, k in counts.items() for e in (b + "*", b + "**")[: min(k, 2)] if e in known]
        forms = forms_of(text, words)
        votes = [2] * (self.voters - len(FORMS) - 1)
        for i in held:
            votes[self.voter[i]] = 1
        trusted = any(self.voter[i] % WORD_VOTERS < ALONE for i in held)
        votes += [*forms, 2 if trusted or not words else 0]  # the last votes clean where none of the best is found
        n = len(known)
        return bytes(votes), sorted(held) + [n + k for k, v in enumerate(forms) if v == 1] + [n + len(FORMS)] * (not held)


def mine(labelled: DataFrame) -> Lexicon:
    """The entries that (text, toxic) rows tell toxic texts by, best first: counted over all toxic rows, then, for what is
    frequent enough there, over all clean ones. Counts are added up where the rows lie."""

    def counted(rows: DataFrame, only=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    counts: Counter[str] = Counter()
                    for text in batch.slice(i, 100).column(0).to_pylist():
                        grams = grams_of({w.lower() for w in WORD.findall(text)})
                        counts.update(grams if only is None else grams & only.value)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        return rows.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))

    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({})
    # Each is in at least LEAST_SHARE of the toxic rows: at most 1 / LEAST_SHARE times the grams of a text, on average.
    often = {r["gram"]: r["n"] for r in counted(labelled.where("toxic = 1")).where(F.col("n") >= max(LEAST_ROWS, LEAST_SHARE * n[1])).collect()}
    only = labelled.sparkSession.sparkContext.broadcast(frozenset(often))
    clean = {r["gram"]: r["n"] for r in counted(labelled.where("toxic = 0"), only).collect()}
    odds = {g: k / n[1] / (clean.get(g, 0) / n[0] + SMOOTHING) for g, k in often.items()}
    best = sorted((-often[g] * math.log(x), g) for g, x in odds.items() if x >= LEAST_ODDS)
    return Lexicon({g: i for i, (_, g) in enumerate(best[:ENTRIES])})


@dataclass
class LabelModel:
    """P(vote | label, vote of the voter before), the voter before each (itself where none is), the share of toxic texts."""

    table: np.ndarray  # voters x labels x votes of the one before x votes
    before: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        logs = np.log(self.table)
        odds = logs[:, TOXIC] - logs[:, CLEAN]
        odds[:, :, NOTHING] = 0  # that a voter says nothing tells nothing: how much of the lexicon a text holds is no evidence
        total = odds[np.arange(votes.shape[1]), votes[:, self.before], votes].sum(1) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def conditional(counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """From counts (voters x labels x votes before x votes) the probabilities of a vote. Without a voter before, all its
    votes are one case. Few cases lean on what the voter votes whatever the other does."""
    alone = counts.sum(2, keepdims=True) + 0.5
    alone /= alone.sum(3, keepdims=True)
    free = (before == np.arange(len(before)))[:, None, None, None]
    table = counts + 2 * alone
    return np.where(free, alone, table / table.sum(3, keepdims=True))


def tree(ones: np.ndarray, pairs: np.ndarray, totals: np.ndarray, apart: tuple[int, ...] = ()) -> np.ndarray:
    """The voter before each: the spanning forest of the greatest mutual information, given the label, between voters'
    speaking at all. ones: labels x voters, pairs: labels x voters x voters, how many spoke; totals: by label. Voters
    `apart` stand alone."""
    voters, info = ones.shape[1], 0.0
    for label in (CLEAN, TOXIC):
        n, both = max(totals[label], 1e-9), pairs[label]
        a, b = ones[label][:, None], ones[label][None, :]
        for k, x, y in ((both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b)):
            k, x, y = (np.maximum(z, 1e-9) for z in (k, x, y))
            info = info + k / max(totals.sum(), 1e-9) * (np.log(k) + math.log(n) - np.log(x) - np.log(y))
    np.fill_diagonal(info, 0)
    info[list(apart)] = info[:, list(apart)] = 0
    before, inside = np.arange(voters), np.zeros(voters, bool)
    for _ in range(voters):
        reach = np.where(inside[:, None] & ~inside[None, :], info, 0)
        a, b = np.unravel_index(int(reach.argmax()), reach.shape)
        if reach[a, b] < TOGETHER:  # nothing hangs on what is in: another tree begins
            b = int(np.argmin(inside))
            a = b
        before[b], inside[b] = a, True
    return before


def fit_label_model(patterns: DataFrame, voters: int, prior: float, steps: int = STEPS) -> LabelModel:
    """From (votes, n, clean, toxic) rows: how often each pattern of votes occurs, and how often with either label. Every
    step passes over all of them where they lie. The estimation begins with the labelled rows, and they stay a part of
    each estimate, so that it does not drift to another division of the texts."""

    def weights(model: LabelModel | None, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        votes = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(-1, voters)
        n, *known = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (1, 2, 3))
        toxic = model.posterior(votes) if model else 0.0
        return votes, np.stack(known) + (np.stack([(1 - toxic) * n, toxic * n]) if model else 0.0)

    def added(size: int, of) -> np.ndarray:
        """Sums over all rows of what `of` adds to an array of so many numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    total += of(batch.slice(i, 2000))
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

        out = np.zeros(size)
        # From each task at most a row for each number; what they add up to is of a size that only the voters set.
        for r in patterns.select("votes", "n", "clean", "toxic").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out

    def cases(model: LabelModel | None, before: np.ndarray) -> np.ndarray:
        def of(rows: pa.RecordBatch) -> np.ndarray:
            votes, weight = weights(model, rows)
            at = (np.arange(voters) * 18 + votes[:, before] * 3 + votes).astype(np.int64)
            return sum(np.bincount((at + 9 * label).ravel(), np.repeat(weight[label], voters), voters * 18) for label in (CLEAN, TOXIC))

        return added(voters * 18, of).reshape(voters, 2, 3, 3)

    def estimated(model: LabelModel | None, before: np.ndarray) -> LabelModel:
        return LabelModel(conditional(cases(model, before), before), before, prior)

    def together(rows: pa.RecordBatch) -> np.ndarray:
        votes, weight = weights(model, rows)
        said = (votes != NOTHING).astype(float)
        return np.concatenate([*((said.T @ (said * w[:, None])).ravel() for w in weight), weight.sum(1)])

    alone = np.arange(voters)
    model = estimated(estimated(None, alone), alone)
    sums = added(2 * voters * voters + 2, together)
    pairs = sums[:-2].reshape(2, voters, voters)
    before = tree(np.stack([np.diag(p) for p in pairs]), pairs, sums[-2:], apart=(voters - 1,))  # the last speaks where the best say nothing
    model = LabelModel(conditional(cases(model, before), before), before, prior)
    for _ in range(steps):
        last, model = model, estimated(model, before)
        if float(np.abs(model.table - last.table).max()) < 1e-4:
            break
    return model


def fit_linear(features: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of the posterior labels on which features a text has; rows that agree in those are one."""
    merged: dict[tuple, list[float]] = {}
    for x, y, k in zip(features, target.tolist(), weight.tolist(), strict=True):
        entry = merged.setdefault(tuple(x), [0.0, 0.0])
        entry[0] += k
        entry[1] += k * y
    keys = list(merged)
    n, y = np.array([merged[k][0] for k in keys]), np.array([merged[k][1] / merged[k][0] for k in keys])
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    col = np.array([c for k in keys for c in k], np.int64)
    w, b = np.zeros(size), 0.0
    m, v, total = np.zeros(size + 1), np.zeros(size + 1), max(n.sum(), 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(keys))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * n / total
        grad = np.append(np.bincount(col, g[row], size) + ridge * w / size, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str = "") -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs; with key_col, a column of longs, also key.

    labels: (doc_id, toxic). Those of ids whose crc32 is divisible by 5 are held out: nothing is learnt from them. A null
    or empty text has no words and is scored by that alone. Null ids are scored and never held out. A repeated label
    counts once where it agrees; an id labelled both ways counts as toxic. Repeated rows of docs each come back, other
    columns are ignored, and without labels of both kinds every score is the share of toxic labels (0.5 without any)."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(key_col).alias("key")] if key_col else [])).withColumn("held_out", held_out)
    own = ["id", "key", "held_out"] if key_col else ["id", "held_out"]
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = written(known.where(~held_out), "labels")
    size, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / size, 1e-4), 1 - 1e-4) if size else 0.5
    # The ids' map goes to the texts, so that of those without a label only few move; the join decides.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    maps = known.select(F.shiftright(place, 15).alias("_of"), place.bitwiseAND(32767).alias("_at")).groupBy("_of").agg(F.call_function("bitmap_construct_agg", "_at").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(place.bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = rows.where(~F.col("held_out") & F.col("id").isNotNull()).join(F.broadcast(maps), F.shiftright(place, 15) == F.col("_of"))
    maybe = maybe.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(7).cast("int"))) != 0).select("id", "text")
    # Merged at every size: what labels there are has no bound.
    lexicon = mine(written(maybe.join(known.hint("merge"), "id").select("text", "toxic"), "labelled"))
    reader = Reader(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reader.read(t.as_py()) for t in batch.column(1)]
            columns = [*(batch.column(c) for c in own), pa.array([v for v, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*own, "votes", "features"])

    seen = written(rows.mapInArrow(read, f"id long, {'key long, ' if key_col else ''}held_out boolean, votes binary, features array<int>"), "votes")
    # Labels join what is left of rows that agree in id and votes; rows without an id have none.
    by_id = seen.groupBy("id", "votes").agg(F.count(F.lit(1)).alias("n"))
    told = by_id.where("id IS NOT NULL").join(known, "id", "left").unionByName(by_id.where("id IS NULL").withColumn("toxic", F.lit(None).cast("int")))
    count = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0)).cast("double")
    patterns = written(told.groupBy("votes").agg(F.sum("n").cast("double").alias("n"), count(0).alias("clean"), count(1).alias("toxic")), "patterns")
    model = fit_label_model(patterns, reader.voters, prior)

    # The more often a pattern occurs the likelier it is drawn; what is drawn stands for as many rows as it should.
    kinds = written(seen.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")), "kinds")
    n = kinds.agg(F.sum("n")).first()[0]
    drawn = kinds.where(F.pmod(F.xxhash64("votes", "features"), F.lit(1_000_000)) < 1e6 * FITTED_ROWS * F.col("n") / n).collect() if n else []
    if drawn:
        votes = np.frombuffer(b"".join(bytes(r["votes"]) for r in drawn), np.uint8).reshape(-1, reader.voters)
        w, b = fit_linear([r["features"] for r in drawn], model.posterior(votes), np.array([max(r["n"], n / FITTED_ROWS) for r in drawn], float), reader.features)
    else:
        w, b = np.zeros(reader.features), 0.0
    if not lexicon.entries:
        w, b = np.zeros(reader.features), math.log(prior / (1 - prior))
    weights = F.broadcast(spark.createDataFrame([Row(weights=w.tolist())], "weights array<double>"))  # as long as the lexicon
    total = F.aggregate("features", F.lit(b), lambda acc, i: acc + F.element_at("weights", i + 1))
    scored = seen.crossJoin(weights).select(*own, (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels).withColumnRenamed("id", "doc_id")
