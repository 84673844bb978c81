"""A stream over landed pages: what it has read, and where it goes on."""

import pytest

from tidemark.sources.paged import LandedPages, landed


def land(folder, number, lines, done=True):
    page = folder / f"page={number}"
    page.mkdir(parents=True)
    half = len(lines) // 2
    (page / "part-0.json").write_text("".join(x + "\n" for x in lines[:half]), "utf-8")
    (page / "part-1.json").write_text("\n".join(lines[half:]), "utf-8")
    if done:
        (page / "_SUCCESS").write_text("")


def test_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    folder, path = tmp_path / "in", f"file://{tmp_path}/in"
    pages = [[f'{{"id": {n * 10 + i}, "t": "é {i}"}}' for i in range(n + 1)] for n in range(6)]
    for n in (0, 1, 2):
        land(folder, n, pages[n], done=n < 2)
    assert landed(path) == 2  # the last is not known to be whole
    out, fail = f"file://{tmp_path}/out", []

    def write(batch, number):
        if fail:
            fail.clear()
            batch.count()
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        stream = spark.readStream.format("landed_pages").load(path)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    got = lambda: sorted((r["page"], r["place"], r["body"]) for r in spark.read.parquet(out).collect())
    want = lambda ns: [(n, i, x) for n in ns for i, x in enumerate(pages[n])]
    run()
    assert got() == want(range(2))
    land(folder, 3, pages[3])
    land(folder, 5, pages[5])  # 4 is missing: 5 waits
    assert landed(path) == 4
    fail.append(1)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert got() == want(range(4))
    land(folder, 4, pages[4])
    run()
    run()
    assert got() == want(range(6))
    batch = spark.read.format("landed_pages").load(path)
    assert sorted((r["page"], r["place"], r["body"]) for r in batch.collect()) == want(range(6))
    assert landed(f"file://{tmp_path}/nothing") == 0
