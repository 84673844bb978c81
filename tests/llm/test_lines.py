"""Line dedup over levelled runs against a plain count."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines as L

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines int, kept string, line string"


def plain(rows, least, shortest):
    keys = lambda t: [x.strip(WS).translate(LOW) for x in (t or "").split("\n")]
    seen = Counter(k for _, t in rows for k in set(keys(t)))
    out = []
    for i, t in rows:
        said = (t or "").split("\n")
        kept = [x for x, k in zip(said, keys(t), strict=True) if len(k) < shortest or seen[k] < least]
        out.append((str(i), len(said), len(said) - len(kept), "\n".join(kept)))
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash", "clash") for i, t in rows], SCHEMA)


def got(df):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    pool = ["Common LINE", " common line\t", "É stays É", "", "  ", "mid", "x" * 50, "日本 line", "\x0bpage\x0c", "a\rb"]
    out = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else f"own {rnd.randrange(200)}" for _ in range(rnd.randrange(1, 12)))) for i in range(120)]
    out += [(None, None), (None, ""), (200, "\n"), (201, "\n\n\n"), (202, "common line\n" * 3000 + "tail"), (203, "z" * 100_000)]
    return out + [(300, "copied text\nof two lines")] * 40 + [(i, "copied text\nof two lines") for i in range(301, 320)]


@pytest.mark.parametrize("least,shortest,batches,fanout,hot", [(10, 1, 8, 4, 4096), (3, 5, 5, 2, 8), (2, 1, 1, 2, 1), (60, 1, 7, 3, 20)])
def test_as_plain(spark, rows, monkeypatch, least, shortest, batches, fanout, hot):
    monkeypatch.setattr(L, "HOT", hot)  # few lines and texts are hot, or all
    found = L.drop_common_lines(docs_of(spark, rows), least=least, shortest=shortest, batches=batches, fanout=fanout)
    assert got(found) == plain(rows, least, shortest)
    assert "line" in found.columns and found.columns.count("kept") == 1


def test_empty(spark):
    assert L.drop_common_lines(docs_of(spark, [])).count() == 0


def test_runs_settle_compact_and_go_on(spark):
    rnd = random.Random(2)
    runs, all_docs = L.LineRuns(spark, least=10, fanout=3), Counter()
    for batch in range(11):
        docs = Counter(f"line {min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(80))
        counts = spark.createDataFrame([(k.encode(), n) for k, n in docs.items()], "line binary, docs long")
        settled = {bytes(r["line"]) for name in runs.names() for r in spark.table(name).where("docs >= 10").collect()}
        runs.add(counts)
        all_docs += docs
        assert all(len(level) < 3 for level in runs.levels)
        if batch % 3 == 1:  # level 0 has the batch's own run: what was settled before is not in it
            own = {bytes(r["line"]) for r in spark.table(runs.levels[0][-1]).collect()}
            assert own == {k.encode() for k in docs} - settled
        if batch == 5:
            runs = L.LineRuns(spark, least=10, fanout=3, folder=runs.folder, levels=runs.levels)
    assert {bytes(r["line"]) for r in runs.common().collect()} == {k.encode() for k, n in all_docs.items() if n >= 10}
    assert [len(x) for x in runs.levels] == [2, 0, 1]
    for name in runs.names():  # each line once
        assert spark.table(name).groupBy("line").count().where("count > 1").count() == 0


def test_query_hash(spark):
    from tidemark.llm.lines import op11_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in plain(rows, 10, 1)]
    found = op11_line_dedup(spark, sf).withColumn("kept", F.col("kept_sha256"))
    assert got(found) == want
