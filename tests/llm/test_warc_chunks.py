"""Chunk rows against plain slicing of the encoded payload."""

import hashlib
import random

from pyspark.sql import functions as F


def test_chunk_rows(spark):
    from tidemark.llm.warc import CHUNK, OUT, chunk_rows

    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["a", "é", "語", "😀", "\n"], k=n)) for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * OUT)]
    texts += ["", "WARC/1.1", "b" * (CHUNK - 3) + "WARC/1.1" + "c" * CHUNK]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, payload string").repartition(2)
    rows = chunk_rows(df, "payload").collect()
    for i, text in enumerate(texts):
        mine, data, at = [r for r in rows if r["id"] == i], text.encode(), 0
        assert [r["segment"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["first"] for r in mine] == [True] + [False] * (len(mine) - 1)
        assert [r["last"] for r in mine] == [False] * (len(mine) - 1) + [True]
        for r in mine:
            part = r["data"].encode()
            at += len(part)
            assert len(part) <= CHUNK + 3 and b"WARC/1.1" not in part
            assert (r["payload_bytes"], r["payload_digest"]) == (at, hashlib.sha256(data[:at]).hexdigest())
        assert "".join(r["data"] for r in mine) == text


def test_large_payloads_take_one_pass(spark):
    """Work and rows grow with the bytes, not with bytes times chunks."""
    from tidemark.llm.warc import CHUNK, chunk_rows, record_digests

    df = spark.range(2).select("id", F.repeat(F.lit("0123456789abcdef"), 1 << 20).alias("payload"))
    got = {r["id"]: (r["n"], r["b"]) for r in chunk_rows(df, "payload").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("b")).collect()}
    assert got == {i: ((1 << 24) // CHUNK, 1 << 24) for i in range(2)}
    want = hashlib.sha256(b"0123456789abcdef" * (1 << 20)).hexdigest()
    assert {tuple(r) for r in record_digests(df, "payload").select("payload_bytes", "payload_digest").collect()} == {(1 << 24, want)}
