"""Periodic runs of words, by the suffix tree's branching tandem repeats.

Of a node of depth D in the suffix tree, two leaves i and i + D make a tandem repeat of period D; it branches where
the next word differs from the repeat's first. Every maximal run ends in exactly one branching repeat of its smallest
period, and the other repeats of the run are that one's rotations to the left, so branching repeats are found first, each is
rotated as far as it goes, and what has the same ends is one run. To find them, each node lists the leaves of all its
children but the largest (the smaller half): O(n log n) in all.

The tree is that of many documents at once. Words are named by document and word, so that suffixes of two documents differ in
their first word; the tree's nodes are intervals of the suffix array, which prefix doubling sorts, with the ranks of each
doubling kept to read common prefixes off. All of this is NumPy over the whole block; only runs are walked one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokenfiles import _blocks

#: Words of a run at least, and repeats of its period.
LEAST, REPEATS = 12, 2
#: Bytes of text whose documents share a tree (a longer text has its own), and leaves that are tested at once.
BLOCK, LEAVES = 1 << 20, 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The suffix array, its inverse, and the ranks by the first 1, 2, 4, ... words; ranks end in a pad below all."""
    n = len(words)
    array = np.argsort(words, kind="stable")
    said = words[array]
    heads = np.flatnonzero(np.concatenate(([True], said[1:] != said[:-1])))
    sizes = np.diff(np.append(heads, n))
    rank = np.full(n + 1, -1, np.int64)
    rank[array] = np.repeat(heads, sizes)
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))  # of those not told apart yet
    levels, step = [rank.astype(np.int32)], 1
    while len(places):
        open_ = array[places]
        keys = rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n)] + 1
        order = np.argsort(keys, kind="stable")
        open_, keys = open_[order], keys[order]
        array[places] = open_
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(heads, len(keys)))
        rank[open_] = np.repeat(places[heads], sizes)
        levels.append(rank.astype(np.int32))
        places = places[np.repeat(sizes > 1, sizes)]
        step *= 2
    return array, rank[:n], levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each suffix the words that it begins with like the one before it in the suffix array; 0 at both ends."""
    n = len(array)
    out = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b = array[at - 1].copy(), array[at].copy()
    for i in range(len(levels) - 1, -1, -1):
        more = (levels[i][a] == levels[i][b]).astype(np.int64) << i
        a, b = a + more, b + more
        out[at] += more
    return out


def _next_smaller(lcp: np.ndarray, inner: np.ndarray, by: int) -> np.ndarray:
    """For each of inner the nearest place before (by -1) or after (by 1) it with a smaller value: places jump over what
    places between have jumped over."""
    to, open_ = np.arange(len(lcp)) + by, inner
    while len(open_):
        open_ = open_[lcp[to[open_]] >= lcp[open_]]
        to[open_] = to[to[open_]]
    return to


def branching_repeats(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all branching tandem repeats."""
    n, none = len(words), np.empty(0, np.int64)
    if n < 2:
        return none, none
    array, rank, levels = suffixes(words)
    lcp = common_prefixes(array, levels)
    del levels
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return none, none
    left, right = _next_smaller(lcp, inner, -1)[inner], _next_smaller(lcp, inner, 1)[inner]
    # A node is an interval (left, right); borders of its depth within cut it into its children.
    order = np.argsort(left * (n + 1) + right, kind="stable")
    border, left, right = inner[order], left[order], right[order]
    first = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    node = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    m = len(heads)
    at, last = np.arange(len(border)) + node, np.append(heads[1:], len(border)) - 1
    start, end, of = (np.empty(len(border) + m, np.int64) for _ in range(3))
    start[at], end[at], of[at] = np.where(first, left, np.concatenate(([0], border[:-1]))), border, node
    tail = last + np.arange(m) + 1
    start[tail], end[tail], of[tail] = border[last], right[last], np.arange(m)
    size = end - start
    largest = np.flatnonzero(size == np.maximum.reduceat(size, heads + np.arange(m))[of])
    small = np.ones(len(size), bool)
    small[largest[np.concatenate(([True], of[largest][1:] != of[largest][:-1]))]] = False
    start, size, of = start[small], size[small], of[small]
    low, high, depth = left[heads], right[heads], lcp[border[heads]]
    padded = np.append(words, -1)
    found = []
    sums = np.cumsum(size)
    cuts = [0, *(np.flatnonzero(np.diff(sums // LEAVES)) + 1).tolist(), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k, o = size[a:b], of[a:b]
        i = array[np.repeat(start[a:b] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        o = np.repeat(o, k)
        d, lo, hi = depth[o], low[o], high[o]
        for x in (i, i - d):  # the leaf as the repeat's first and as its second half
            other = np.where(x == i, x + d, x)
            there = (other >= 0) & (other < n)
            r = rank[np.where(there, other, 0)]
            there &= (r >= lo) & (r < hi)
            there[there] = words[x[there]] != padded[np.minimum(x[there] + 2 * d[there], n)]
            found.append((x[there], d[there]))
    starts, periods = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(starts * (n + 1) + periods)
    return both // (n + 1), both % (n + 1)


def _rotated(words: np.ndarray, i: int, period: int) -> int:
    """Where the leftmost rotation of the repeat at i starts."""
    step = 64
    while i > 0:
        low = max(0, i - step)
        other = np.flatnonzero(words[low:i] != words[low + period : i + period])
        if len(other):
            return low + int(other[-1]) + 1
        i, step = low, 2 * step
    return 0


def maximal_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of every maximal run of at least `least` words, with its smallest period."""
    starts, periods = branching_repeats(words)
    # Short repeats must turn a few times to the left to be long enough.
    for turn in range(1, least - REPEATS + 1):
        asked = REPEATS * periods + turn <= least
        at = starts - turn
        ok = ~asked | ((at >= 0) & (words[np.maximum(at, 0)] == words[np.minimum(at + periods, len(words) - 1)]))
        starts, periods = starts[ok], periods[ok]
    ends = starts + REPEATS * periods
    order = np.lexsort((periods, ends))
    out, known, at_end = [], [], -1
    for i, q, e in zip(starts[order].tolist(), periods[order].tolist(), ends[order].tolist(), strict=True):
        if e != at_end:
            known, at_end = [], e
        if any(q % p == 0 and i >= s for s, p in known):
            continue  # whole periods of a run that ends here
        s = _rotated(words, i, q)
        known.append((s, q))
        out.append((s, e, q))
    return out


def _found(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    lists = pc.ascii_split_whitespace(pc.fill_null(rows.column(1), ""))
    said = lists.flatten().dictionary_encode()
    whole = pc.binary_length(said.dictionary).to_numpy() > 0
    codes = said.indices.to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    real = whole[codes] if len(codes) else np.empty(0, bool)
    ends = np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]]  # where documents begin and end
    codes, docs = codes[real], np.repeat(np.arange(len(rows)), np.diff(ends))
    _, words = np.unique(docs.astype(np.int64) * (len(whole) + 1) + codes, return_inverse=True)
    runs = [(int(docs[s]), s, e, q) for s, e, q in maximal_runs(words, least)]
    runs = sorted((d, s - int(ends[d]), e - s, q) for d, s, e, q in runs)
    doc, start, length, period = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([],) * 4))
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, ends[doc] + start + period, 1)
    np.add.at(cover, ends[doc] + start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    words_kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept)))[ends].astype(np.int32)), said.dictionary.take(pa.array(codes[kept])))
    parts = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    counts = np.bincount(doc, minlength=len(rows))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), parts)
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ends)), listed, pc.binary_join(words_kept, " ")], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, runs (start, length, period in words; by start, then period) and collapsed of each row: the words, joined
    by one space, but for those that a run holds after its first period.

    Words are what white space of ASCII leaves. A null text has no words, like an empty one. Repeated rows and null ids are
    rows like any other, other columns are ignored, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _blocks(batch, 1, BLOCK):
                yield _found(rows, least)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The text, in every tenth document (by the CRC-32 of its id) made periodic from some word on; a null id plants
    nothing."""
    words = F.filter(F.split(text, r"[ \x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(doc_id.cast("string"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))  # words are split once
    return F.when(h % 10 == 0, made[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of each
    document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs(docs.withColumn("text", with_planted_periods(F.col("text"), F.col("doc_id"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = rows.withColumn("longest", longest)
    length = -F.col("longest.least")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-longest.least * 1000) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
