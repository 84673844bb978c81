"""Disclosing terms and what becomes of the texts, against plain counts; texts with very many spans."""

import math
import random
import re
import time
from collections import Counter

import pytest
from test_llm import base_spans

from tidemark.llm.pii import GENERALISE, MIN_DOCS, MIN_LETTERS, REMOVE, sanitise

DOCS = "doc_id long, text string"
LETTERS = re.compile(r"[^\W\d_]+")


def plain(texts):
    """(terms, sanitised) of each text."""
    base = [base_spans(t or "") for t in texts]
    values = [{(k, t[s:e]) for k, s, e in b} if t else set() for t, b in zip(texts, base, strict=True)]
    often = Counter(v for vs in values for v in vs)
    entities = [{f"{k}:{v}" if often[k, v] >= MIN_DOCS else k for k, v in vs} for vs in values]
    words = [{w for w in LETTERS.findall(t or "") if len(w) >= MIN_LETTERS} for t in texts]
    n_term, n_entity, n_both = Counter(w for ws in words for w in ws), Counter(e for es in entities for e in es), Counter()
    for es, ws in zip(entities, words, strict=True):
        n_both.update((e, w) for e in es for w in ws)
    degree = {}
    for (e, w), n in n_both.items():
        content = math.log(len(texts) / n_entity[e])
        if n >= MIN_DOCS and content > 0:
            d = math.log(n * len(texts) / (n_term[w] * n_entity[e])) / content
            if d >= GENERALISE:
                degree[e, w] = d
    out = []
    for t, b, vs in zip(texts, base, values, strict=True):
        t = t or ""
        mine = {}
        for k, v in vs:
            for e in (k, f"{k}:{v}"):
                for (e2, w), d in degree.items():
                    if e2 == e:
                        mine[w] = max(d, mine.get(w, 0))
        hits = [(m.start(), m.end(), m.group()) for m in LETTERS.finditer(t) if m.group() in mine] if b else []
        terms = [h for h in hits if not any(s < h[1] and h[0] < e for _, s, e in b)]
        swaps = [(s, e, f"[{k.upper()}]") for k, s, e in b]
        swaps += [(s, e, "" if mine[w] >= REMOVE else "[ACRONYM]" if w.isupper() else "[Name]" if w[0].isupper() else "[word]") for s, e, w in terms]
        at, put = 0, ""
        for s, e, by in sorted(swaps):
            if s >= at:
                put, at = put + t[at:s] + by, e
        out.append((terms, put + t[at:]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_as_counted(spark, seed):
    rnd = random.Random(seed)
    topics = [["Zephyr", "NATO", "meets", "één"], ["Kilo", "lima"], ["Papa", "quebec", "Romeo"]]
    addresses = ["a@b.example", "boss@corp.example", "+44 20 7946 0000", "10.1.2.3", "4111 1111 1111 1111"]
    filler = ["the", "of", "everyone", "notes", "x", "mail", "été"]
    texts = [None, "", "no one", "éa@b.example and éé", "a@b.example+44 20 7946 0000 10.1.2.3.4.5.6.7"]
    for i in range(150):
        some = [rnd.choice(filler) for _ in range(rnd.randrange(2, 12))]
        k = i % 7
        if k < 3:
            some += rnd.sample(topics[k], rnd.randrange(1, len(topics[k]) + 1)) + [addresses[k] if rnd.random() < 0.8 else f"u{i}@x.example"]
            some += ["" if rnd.random() < 0.7 else addresses[3 + k % 2]]
        elif rnd.random() < 0.1:
            some += topics[0][:1]
        rnd.shuffle(some)
        texts.append(" ".join(some) if rnd.random() < 0.8 else "".join(some))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    got = {r["doc_id"]: r for r in sanitise(df).collect()}
    want = plain(texts)
    for i, (terms, put) in enumerate(want):
        assert [(t["start"], t["end"], t["term"]) for t in got[i]["terms"]] == terms, texts[i]
        assert (got[i]["sanitised"] or "") == put, texts[i]
    assert sum(len(t) for t, _ in want) > 20


def test_very_many_spans(spark):
    text = lambda n: " ".join(f"on {i} a{i}@b.example did" for i in range(n))
    took = {}
    for n in (10, 4000, 32_000):
        df = spark.createDataFrame([(1, text(n))], DOCS)
        began = time.time()
        (row,) = sanitise(df).collect()
        took[n] = time.time() - began
        assert len(row["base"]) == n
        assert row["sanitised"] == re.sub(r"a\d+@b\.example", "[EMAIL]", text(n))
    assert took[32_000] - took[10] < 30  # by the square of the spans: some minutes
