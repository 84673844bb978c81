"""Token counts of documents in flat token files, which hold nothing but ids, each document's end id last.

The files have no index, so their documents are found by scanning: every block of a file is searched for the end id as
one array comparison. A document may begin in one block and end in another; a prefix scan over the blocks' summaries
(tokens, end ids, tokens after the last end id) tells each block how many tokens it takes over and how many documents
came before, one row for each block. Blocks are read by offset, so no task holds more than one block of a file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written

#: Tokens of a block.
BLOCK = 1 << 22


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@lru_cache(1)
def _encoding(ranks: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as file:
        pairs = [line.split() for line in file]
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def write_flat(docs: DataFrame, path: str, ranks: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Writes flat token files, one for each task that has rows, and returns (file, place, id): which document is where.

    A task names its file by chance and tells the name in its rows, so that what a lost or repeated attempt has written is
    never looked at. A null text counts as an empty one, which has the end id alone. Raises where an id doesn't fit."""
    most = np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, out, name = _encoding(ranks, pattern).encode_ordinary, 0, None, f"{path}/{uuid.uuid4().hex}.tokens"
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    rows = batch.slice(i, 100)
                    if out is None:
                        fs, place = _open(name)
                        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(place)
                    for t in rows.column(1).to_pylist():
                        ids = np.array([*encode(t or ""), end_id], np.int64)
                        if ids.max() > most:
                            raise ValueError(f"the id {ids.max()} does not fit {dtype}")
                        out.write(ids.astype(dtype).tobytes())
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), rows.column(0)], ["file", "place", "id"])
                    at += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "file string, place long, id long"), "places")


def token_counts(files: DataFrame, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, place, n_tokens): for each document of each file its number and its tokens, the end id with them. What follows a file's last end id is a document without one. files: (file); repeated ones count once, an empty
    file has no documents. No id but the end id has a meaning."""
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, place = _open(name)
                size = fs.get_file_info(place).size
                if size % width:
                    raise ValueError(f"{name} is no file of {dtype}")
                starts = list(range(0, size // width, block))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array([min(block, size // width - s) for s in starts], pa.int64())], ["file", "at", "tokens"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = _open(name)
                with fs.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at(n * width, at * width), dtype)
                ends = np.nonzero(ids == end_id)[0] + 1
                rest = n - int(ends[-1]) if len(ends) else n
                lengths = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(np.diff(ends, prepend=0), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([rest], pa.int64()), lengths], ["file", "at", "tokens", "ends", "rest", "lengths"])

    names = files.select("file").distinct()
    blocks = written(names.mapInArrow(cut, "file string, at long, tokens long"), "blocks")
    spread = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = "file string, at long, tokens long, ends long, rest long, lengths array<long>"
    seen = written(blocks.repartition(spread, "file", "at").mapInArrow(scan, kinds), "scanned")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # Taken over: the tokens since the last block that has an end id, and what that one leaves.
    sums = seen.select("file", "at", "tokens", "ends", "rest")
    total = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    sums = sums.withColumns({"_sum": total, "place": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    left = F.last(F.when(F.col("ends") > 0, F.col("_sum") + F.col("tokens") - F.col("rest")), ignorenulls=True).over(before)
    sums = sums.withColumn("begin", F.coalesce(left, F.lit(0))).withColumn("over", F.col("_sum") - F.col("begin"))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at"))) == 1
    sums = sums.withColumn("is_last", last)
    rows = seen.select("file", "at", "lengths").join(sums, ["file", "at"])
    inside = rows.where("ends > 0").select("file", "place", "over", F.posexplode("lengths").alias("i", "n"))
    inside = inside.withColumn("n_tokens", F.col("n") + F.when(F.col("i") == 0, F.col("over")).otherwise(0)).withColumn("place", F.col("place") + F.col("i"))
    tail = rows.where("is_last AND (rest > 0)").select("file", (F.col("place") + F.col("ends")).alias("place"), (F.col("rest") + F.when(F.col("ends") == 0, F.col("over")).otherwise(0)).alias("n_tokens"))
    return inside.select("file", "place", "n_tokens").unionByName(tail)


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (with the end id) of each document, counted in flat files of its ids."""
    import public_tokenizers

    end = 50256
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = write_flat(docs, new_path(spark, "flat"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end)
    counts = token_counts(places.select("file").distinct(), end)
    return places.join(counts, ["file", "place"]).select(F.col("id").alias("doc_id"), "n_tokens")
