"""Token ids as Parquet list columns.

One row for each document, in ascending order of id: part, id, start_in_part, n_tokens, ids (list<int>). The ids are
dictionary-encoded (a vocabulary of up to 65,536 ids takes at most two bytes an id), the counters delta-encoded, row
groups and pages have set sizes and the files have page indexes, so that a reader can take the counters alone, or the ids
of a few documents, without reading the rest. Spark writes and reads the files wherever they lie."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

#: Bytes of a row group and of a page; rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Pretokens whose ids a worker remembers, the longest of them, and bytes of text that are encoded together.
KNOWN, LONGEST, BLOCK = 1 << 19, 48, 4 << 20
#: How the tokenizer cuts texts; below, what of that is not a run of letters.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NOT_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+)"
#: Beyond Latin-1 a normal form may be more than the lower case; these two of it are white space to the tokenizer alone.
UNUSUAL = r"[^\x{00}-\x{FF}]|\x{85}|\x{A0}"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte that prints as itself, the others as the letters from U+0100 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


def _gathered(flat: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after the other: those taken, in that order, likewise, and their sizes."""
    n, starts = sizes[take], np.cumsum(sizes) - sizes
    return flat[np.repeat(starts[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _totals(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(sizes)))[offsets]
    return sums[1:] - sums[:-1]


class BlockEncoder:
    """The ids of many texts at once.

    A tokenizer that drops white space has no token across it, so the different words of a block of texts are encoded, and
    Arrow and NumPy put their ids together again. Words of Latin-1 letters are cut to pretokens, whose normal form is their
    lower case, and each different one goes to the tokenizer's model once and is remembered; any other word, and one that
    may hold a special token, goes through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        forms = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        direct = cuts == [PRETOKEN, None] and forms == ["NFC", "Replace", "Lowercase"]
        self.whole = "|".join([UNUSUAL, *(re.escape(t["content"][:1]) for t in spec["added_tokens"])]) if direct else ""
        self.tokenize, self.letters, self.known = self.tokenizer.model.tokenize, byte_letters(), {}

    def _pretoken(self, x: str) -> bytes:
        plain = x.isascii() and x.isalpha()
        tokens = self.tokenize(x if plain else x.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(tokens)}i", *[t.id for t in tokens])

    def _word(self, x: str) -> bytes:
        return np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<i4").tobytes()

    def _ids(self, units: pa.Array, one) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each has."""
        known, out = self.known, []
        if len(known) > KNOWN:
            known.clear()
        for x in units.to_pylist():
            ids = known.get(x)
            if ids is None:
                ids = one(x)
                if len(x) <= LONGEST:
                    known[x] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id last, one after the other, and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = lists.flatten().dictionary_encode()
        words, said = found.dictionary, found.indices.to_numpy()
        odd = pc.match_substring_regex(words, self.whole)
        usual = words.filter(pc.invert(odd))
        cores = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(usual), NOT_LETTERS, r" \1 "))
        parts = cores.flatten().dictionary_encode()
        flat, n = _gathered(*self._ids(parts.dictionary, self._pretoken), parts.indices.to_numpy())
        more, k = self._ids(words.filter(odd), self._word)
        # The words' ids: usual ones first, then the others, then the end id.
        sizes = np.concatenate((_totals(n, cores.offsets.to_numpy()), k, [1]))
        flat = np.concatenate((flat, more, [end_id])).astype(np.int32)
        odd = odd.to_numpy(zero_copy_only=False)
        place = np.where(odd, len(usual) + np.cumsum(odd), np.cumsum(~odd)) - 1
        offsets = lists.offsets.to_numpy()
        taken = np.insert(place[said], offsets[1:] - offsets[0], len(words))
        flat, n = _gathered(flat, sizes, taken)
        return flat, _totals(n, offsets - offsets[0] + np.arange(len(offsets)))


@lru_cache(1)
def _encoder(path: str) -> BlockEncoder:
    return BlockEncoder(path)


def _blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have `most` bytes, or little more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "left")) + 1
        yield batch.slice(begin, end - begin)
        begin = end


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group: int = ROW_GROUP, page: int = PAGE
) -> None:
    """Writes the ids of each row, its end id last, in ascending order of id (null ids first, equal ids in any order).

    A null text counts as an empty one, which has the end id alone. Other columns are ignored. An empty table writes
    files without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(tokenizer), 0
        for batch in batches:
            for rows in _blocks(batch, 1):
                flat, n = encoder.encode(rows.column(1), end_id)
                offsets = np.concatenate(([0], np.cumsum(n)))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at + offsets[:-1]), pa.array(n), ids], ["id", "start_in_part", "n_tokens", "ids"])
                at += int(offsets[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The text's hash parts rows without an id, and equal ids, among tasks.
    rows = rows.orderBy(F.asc_nulls_first("id"), F.xxhash64("text")).mapInArrow(run, "id long, start_in_part long, n_tokens long, ids array<int>")
    options = {
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("id", "start_in_part", "n_tokens")},
    }
    rows.select(F.spark_partition_id().alias("part"), "*").write.options(**{k: str(v) for k, v in options.items()}).option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids in all parts before each part. Reads one counter; one row for each part, thus for each file."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and the columns asked for; with none, the counters alone are read."""
    rows = spark.read.parquet(path)
    rows = rows.join(F.broadcast(starts(spark, path)), "part")
    return rows.select("id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", *columns)


def with_crc32(rows: DataFrame) -> DataFrame:
    """id, start, n_tokens, ids_crc32: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return rows.select("id", "start", "n_tokens", "ids").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return with_crc32(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")
