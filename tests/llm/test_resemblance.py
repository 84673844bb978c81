"""Near-duplicates by exact Jaccard similarity, against brute force."""

import random

import numpy as np
import pytest


def words(rnd, n, of):
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


def copy_of(rnd, base, kind, of):
    """A copy whose five-word similarity to base is a little over 0.8."""
    n = len(base)
    if kind == "append":
        return base + words(rnd, int(n * 0.2), of)
    if kind == "cut":
        return base[: n - int(n * 0.17)]
    if kind == "passage":  # in the middle
        return base[: n // 2] + words(rnd, int(n * 0.2) - 8, of) + base[n // 2 :]
    out = list(base)
    for i in range(5, n - 5, max(n // max(n // 55, 1), 55)):
        out[i] = "edited"
    return out


def jaccard(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n", [60, 200, 1000])
@pytest.mark.parametrize("kind", ["append", "cut", "passage", "edit"])
def test_candidates_of_each_kind_of_copy(kind, n):
    from tidemark.llm.resemblance import band_keys, shingle_set

    rnd, tried = random.Random(n), 0
    for _ in range(100):
        base = words(rnd, n, 3000)
        other = copy_of(rnd, base, kind, 3000)
        if jaccard(base, other) >= 0.8:
            tried += 1
            a, b = (band_keys(shingle_set(" ".join(t).encode())) for t in (base, other))
            assert (a == b).any()
    assert tried > 50
    assert not len(band_keys(shingle_set(b" ")))


@pytest.mark.parametrize("block", [4, 1024])
def test_links_are_exact(spark, monkeypatch, block):
    from tidemark.llm import resemblance

    monkeypatch.setattr(resemblance, "TEXT_BLOCK", block)
    rnd, texts = random.Random(3), []
    for n in (40, 60, 100):
        base = words(rnd, n, 500)
        texts.append(base)
        for share in (0.05, 0.1, 0.2, 0.25, 0.3, 0.4):
            texts += [base + words(rnd, int(n * share), 500), base[: int(n * (1 - share))], base[: n // 2] + words(rnd, int(n * share), 500) + base[n // 2 :]]
    texts = [" ".join(t) for t in texts] + ["", None, " \t", "a b c", "A b  c", "a b d", texts[0][0] + " x y"]
    up = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = ((t or "").lower().split() for t in (a, b))
            if not x and not y or x and y and (min(len(x), len(y)) >= 5 or len(x) == len(y)) and jaccard(x, y) >= 0.8:
                up = [up[j] if r == up[i] else r for r in up]
    got = {r["id"]: r["root"] for r in resemblance.near_copies(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), ["id"]).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i] == got[j]) == (up[i] == up[j]), (texts[i], texts[j])


def test_stage_keeps_what_is_below(spark):
    pytest.importorskip("public_tokenizers")
    from corpus_pipeline import drop_near_duplicates

    rnd, rows = random.Random(8), []
    for i in range(40):
        base = words(rnd, 200, 3000)
        rows += [(10 * i, base), (10 * i + 1, base + words(rnd, 46, 3000)), (10 * i + 2, base + words(rnd, 60, 3000))]  # 0.81, 0.77
        assert jaccard(base, rows[-2][1]) >= 0.8 > jaccard(base, rows[-1][1]) and jaccard(rows[-2][1], rows[-1][1]) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in drop_near_duplicates(spark, docs, "").collect()} == {i for i, _ in rows if i % 10 != 1}


def test_stages_without_ids_and_with_shared_ids(spark):
    pytest.importorskip("public_tokenizers")
    from corpus_pipeline import drop_contaminated, drop_near_duplicates

    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 60").first()["text"]
    rnd = random.Random(6)
    one, two, three = (" ".join(words(rnd, 80, 3000)) for _ in range(3))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    told = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    rows = [(None, one), (1, one), (None, two), (None, two + " more"), (5, two + " other"), (7, three), (7, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], kinds)
    got = drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, one), (5, two + " other"), (7, three), (0, "")])
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in [(None, item), (None, one), (3, item), (3, two)]], kinds)
    assert told(drop_contaminated(spark, docs, "/root/testdata/sf0.001")) == sorted([(0, one), (3, two)])


def test_toxic_rows_without_ids_go(spark):
    pytest.importorskip("public_tokenizers")
    import tempfile

    from corpus_pipeline import drop_toxic

    rnd, rows = random.Random(9), []
    for i in range(600):
        text = [rnd.choice(["the", "of", "and", "river", "stone", "cloud"]) + rnd.choice(["", "s", "er"]) for _ in range(20)]
        rows.append((i, " ".join(text[:3] + ["grumbleface"] * (i % 4 == 0) + text[3:]), i % 4 == 0))
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    toxic, clean = rows[0][1] + " end", rows[1][1] + " end"
    docs = [(i, t, "en", "s", None) for i, t, _ in rows] + [(i, t, "en", "s", None) for i in (None, 9000) for t in (toxic, clean)]
    got = [(r["doc_id"], r["text"]) for r in drop_toxic(spark, spark.createDataFrame(docs, kinds), folder).collect()]
    assert {x for x in got if x[0] in (None, 9000)} == {(None, clean), (9000, clean)}
