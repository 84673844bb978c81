"""Payloads that quote the start of a WARC record at the ends of a payload or across chunks."""

import hashlib

import pytest


@pytest.mark.parametrize("chunk", [7, 16, 1 << 16])
def test_quoted_record_starts(spark, tmp_path, chunk):
    from tidemark.llm.warc import read_records, write_warc

    start = "WARC/1.1\r\nWARC-Type: response"
    texts = [start, "a\nWARC/1.1", "WARC/1.1", "\nWARC/1.1", "WARC/1.1\r", "\nWARC/1.1\r", f"{start}\n{start}\nWARC/1.1", "WARC/1.1WARC/1.1"]
    texts += ["x" * n + "\n" + start + "\nWARC/1.1" for n in range(18)]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(2)
    write_warc(df, path := f"file://{tmp_path}/w", chunk=chunk)
    got = sorted((r["id"], r["payload_bytes"], r["payload_digest"]) for r in read_records(spark, path).collect())
    assert got == [(i, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]
