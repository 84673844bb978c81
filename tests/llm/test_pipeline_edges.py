"""The pipeline's stages on odd tables: no rows, nulls everywhere, repeated rows, columns with clashing names."""

import random

import pytest

pytest.importorskip("public_tokenizers")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, key string, row_key int, root array<int>"
SF = "/root/testdata/sf0.001"


def rows():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") * rnd.randint(1, 4) for _ in range(60)) for _ in range(6)]
    out = [(i, t, "en", "s", len(t), "k", i, [i]) for i, t in enumerate(texts)]
    out += [out[0], (None, texts[1], None, None, None, None, None, None), (9, None, None, None, None, None, None, None), (10, "", None, None, None, None, None, None)]
    return [*out, (None,) * 8, (11, "a " * 200_000 + texts[2], "de", "s", None, "q", 1, None)]


@pytest.mark.parametrize("stage", range(4))
def test_stage(spark, stage):
    import corpus_pipeline

    _, f = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(rows(), KINDS)
    got = f(spark, docs, SF)
    assert got.columns == docs.columns
    found = sorted(map(repr, (r[0] for r in got.collect())))
    if stage == 1:
        assert found == sorted(map(repr, [*range(6), 9]))  # 11 has the shingles of 2; of texts without words the smallest id stays
    else:
        assert found == sorted(map(repr, (r[0] for r in rows())))
    assert f(spark, docs.limit(0), SF).count() == 0


def test_last_stage(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(rows(), KINDS)
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows())
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
