"""The block index against all pairs, and the recall of the fingerprints on edited passages of the benchmark."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import decontaminate as d


@pytest.mark.parametrize("entries", [0, 3_000, 1 << 16, 1 << 21])
def test_index_finds_all_within_the_radius(entries, monkeypatch):
    monkeypatch.setattr(d, "MOST_ENTRIES", entries)
    monkeypatch.setattr(d, "PAIRS", 5_000)
    rnd = random.Random(entries)
    items = [(i, " ".join(rnd.choice("abcdef") * rnd.randint(1, 3) for _ in range(30))) for i in range(60)]
    found = d.Items(items)
    prints = found.prints[30]
    windows = np.random.default_rng(1).integers(0, 1 << 64, 300, np.uint64)
    for i in range(200):  # some are near an item
        windows[i] = prints[i % len(prints)] ^ np.uint64(sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 24))))
    w, i = found.candidates(30, windows)
    near = np.bitwise_count(windows[:, None] ^ prints[None, :]) <= d.RADIUS
    assert [*zip(w.tolist(), i.tolist())] == [*zip(*(x.tolist() for x in np.nonzero(near)))]


def edited(rnd, words, similar):
    """A copy with words changed, put in, left out or moved in one place or more, whose similarity is at least `similar`."""
    best = words
    for _ in range(rnd.randint(1, 12)):
        copy, at = list(best), rnd.randrange(len(best))
        kind = rnd.randrange(4)
        if kind == 0:
            copy[at] = "zz%d" % rnd.randrange(999)
        elif kind == 1:
            copy.insert(at, "yy%d" % rnd.randrange(999))
        elif kind == 2:
            del copy[at]
        else:
            copy = copy[at:] if at < len(copy) // 6 else copy[: at + 1] if at > 5 * len(copy) // 6 else copy
        if len(copy) < 5 or d.similarity(d.shingles(copy), d.shingles(words)) < similar:
            break
        best = copy
    return best


def test_recall_on_edited_passages():
    """All edited copies, of 0.8 and more, of 0.85 and of 0.9, are within the radius: 99.9 % of them at the least."""
    items = [t.lower().encode().split() for t in pq.read_table("/root/testdata/sf0.1/benchmark.parquet")["text"].to_pylist() if t]
    items = [[w.decode() for w in words] for words in items if len(words) >= 12]
    rnd, missed, n, farthest = random.Random(3), 0, 0, 0
    mark = lambda words: d._packed(d._bits(h := d.shingle_hashes(d.word_hashes([w.encode() for w in words]), 5)).sum(0, dtype=np.int64)[None], len(h))[0]
    for words in items:
        for similar in (0.8, 0.8, 0.8, 0.85, 0.9):
            copy = edited(rnd, words, similar)
            apart = int(np.bitwise_count(mark(words) ^ mark(copy)))
            n, missed, farthest = n + 1, missed + (apart > d.RADIUS), max(farthest, apart)
    assert n > 500 and missed <= n // 1000, (n, missed, farthest)
