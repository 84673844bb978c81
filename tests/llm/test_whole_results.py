"""Whole results of queries that SQL can't say: token counts, shards, scores on held-out rows."""

import heapq
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_separator_scan_counts_what_the_tokenizer_says(spark):
    import base64

    import tiktoken

    from tidemark.llm.separators import op6_separator_scan

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: len(encoding.encode_ordinary(t)) + 1 for i, t in documents(spark)}
    assert {r["doc_id"]: r["n_tokens"] for r in op6_separator_scan(spark, SF).collect()} == want


def spread(loads):
    return max(loads) - min(loads)


@pytest.mark.parametrize("kind", ["documents", "long", "one"])
def test_shards_are_as_even_as_a_heap_makes_them(spark, kind):
    from tidemark.llm.shards import lpt_shards

    rows = documents(spark)
    if kind == "long":
        rows = [(i, "x" * (3000 + 977 * i % 50_000)) for i in range(60)]
    if kind == "one":  # a text with most of all bytes
        rows = [(i, "y" * 40_000 if i < 30 else f"text {i} " * (i % 40)) for i in range(200)]
    got = lpt_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8).collect()
    groups, texts = Counter(), dict(rows)
    for _, t in rows:
        groups[t] += len(t.encode()) + 1
    heap = [(0, i) for i in range(8)]
    for n in sorted(groups.values(), reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, i))
    loads, where, slots = Counter({i: 0 for i in range(8)}), {}, {}
    for r in got:
        t = texts[r["id"]]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert where.setdefault(t, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    # Sizes are classed to 1 in 1024.
    assert spread(loads.values()) <= spread([n for n, _ in heap]) + sum(groups.values()) / 8 / 512 + 8


def test_toxicity_of_held_out_rows(spark):
    """The whole query on sf0.1, of which 20 % is held out, against the labels. (sf0.01 holds a few toxic rows out, and its
    lexicon is learnt from 45: the README has its figures.)"""
    from tidemark.llm.toxicity import op4_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(toxic) > 50 and len(clean) > 300
    ranked = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert ranked > 0.85
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.05
