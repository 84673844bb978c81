"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import periods as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least=12):
    """All (start, length, period) with the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples():
    rnd = random.Random(8)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 400, ["a", "b"] * 6, ["a", "b"] * 6 + ["a"], list("abcabdabcabd") * 3]
    fib = ["a", "ab"]
    while len(fib) < 14:
        fib.append(fib[-1] + fib[-2])
    out += [list(x) for x in fib[8:]]
    out += [[rnd.choice("ab") for _ in range(rnd.randrange(150))] for _ in range(60)]
    out += [[rnd.choice("abcdef") for _ in range(rnd.randrange(60))] * rnd.randrange(1, 5) + [rnd.choice("abc") for _ in range(20)] for _ in range(60)]
    return out


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_a_block(least, monkeypatch):
    monkeypatch.setattr(P, "LEAVES", 50)
    docs = samples()
    names, flat = {}, []
    for d, words in enumerate(docs):
        flat += [names.setdefault((d, w), len(names)) for w in words]
    starts = np.cumsum([0, *map(len, docs)])
    got = {d: [] for d in range(len(docs))}
    for s, e, q in P.maximal_runs(np.array(flat, np.int64), least):
        d = int(np.searchsorted(starts, s, "right")) - 1
        got[d].append((s - int(starts[d]), e - s, q))
    for d, words in enumerate(docs):
        assert sorted(got[d]) == plain(words, least), words


def test_long_repeats_are_quick():
    began = time.time()
    assert P.maximal_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    words = np.tile(np.arange(1000), 200)
    assert P.maximal_runs(words) == [(0, 200_000, 1000)]
    assert time.time() - began < 60


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 300)
    texts = [" ".join(x) for x in samples()] + [None, "", " \t\n", "\x0bé é\x0c" * 20, "x\x1cy " * 12, "x y " * 13, "  a  b\n" * 9, "  a  b\n" * 9]
    rows = [(None if i % 7 == 0 else i, t, 1, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, collapsed string").repartition(3)
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = plain(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    got = [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def contract(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(80)))) for i in range(300)] + [(400, None), (401, ""), (402, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {contract(i, t) for i, t in rows}


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    few = {i: t for i, t in rows if len(t or "") < 12_000}
    got = {r["doc_id"]: tuple(r) for r in P.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in few} == {i: contract(i, t) for i, t in few.items()}
    assert sum(x[1] > 0 for x in got.values()) > len(rows) // 20
