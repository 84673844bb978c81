"""WARC archives as tables of chunks.

A payload is never held a second time as a whole: it is cut into rows (record, chunk number, data) of some CHUNK bytes,
slices of the buffer that it came in, and the SHA-256 of a record is carried from chunk to chunk. A payload of several chunks becomes a segmented record (one first segment, then `continuation` records, as the WARC standard has
them), so that reading an archive needs memory for a segment, not for a record.

Archives are written by Spark's text writer, one row for each record or segment, and read by its text reader with the
start of the next record as the line separator, so they lie wherever Spark reaches. Readers split archives written with
compression "none" or "bzip2"; one written with gzip, the usual form, is read by one task, so its writer's partition
sets that task's size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Bytes of a chunk (up to 3 more or fewer, at the border of a character), and of the rows that leave a task at once.
CHUNK, OUT = 1 << 16, 1 << 22
#: Payloads of fewer bytes never become revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
#: Begins each record but a file's first; no payload chunk may contain it.
NEXT_RECORD = "\nWARC/1.1\r"
RECORD_START = re.compile(rb"WARC/1\.1")


def chunk_ends(data: memoryview, start: int, end: int, chunk: int) -> list[int]:
    """Where the chunks of data[start:end] end: after each `chunk` bytes, moved back to the start of a character, and
    inside each start of a WARC record, so that no chunk holds one, be it at its ends or across two chunks."""
    stops = {m.start() + 4 for m in RECORD_START.finditer(data, start, end)}
    for stop in range(start + chunk, end, chunk):
        while stop > start and data[stop] & 0xC0 == 0x80:
            stop -= 1
        stops.add(stop)
    stops.discard(start)
    return [*sorted(stops), end]


def payloads(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The offsets of a string column's values, and the bytes that they lie in."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int32), pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1], data or pa.py_buffer(b"")


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def record_digests(records: DataFrame, payload: str) -> DataFrame:
    """Replaces the string column `payload` (no nulls) by payload_bytes and payload_digest, taken chunk by chunk."""
    others = records.drop(payload)
    names = others.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = payloads(batch.column(payload))
            view, sums = memoryview(data), []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                digest = hashlib.sha256()
                for at in range(start, end, CHUNK):
                    digest.update(view[at : min(at + CHUNK, end)])
                sums.append(digest.hexdigest())
            columns = [*batch.select(names).columns, pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "payload_bytes", "payload_digest"])

    return records.mapInArrow(run, f"{fields(others)}, payload_bytes long, payload_digest string")


def chunk_rows(records: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """Replaces the string column `payload` (no nulls) by a row for each chunk, in order, the rows of a record together:
    data, first, last, segment (1, 2, ...), and payload_bytes and payload_digest up to and with the chunk.

    Chunks are offsets into the batch that came in, so no payload is copied before the rows are sent on, some OUT bytes
    at a time."""
    others = records.drop(payload)
    names = others.columns
    added = ["data", "first", "last", "segment", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = payloads(batch.column(payload))
            view = memoryview(data)
            rows, ends, segments, sizes, sums, lasts = [], [], [], [], [], []
            for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                digest, at = hashlib.sha256(), start
                for no, stop in enumerate(chunk_ends(view, start, end, chunk), 1):
                    digest.update(view[at:stop])
                    at = stop
                    rows.append(row)
                    ends.append(stop)
                    segments.append(no)
                    sizes.append(stop - start)
                    sums.append(digest.hexdigest())
                    lasts.append(stop == end)
            borders = pa.py_buffer(np.array([offsets[0], *ends], np.int32).tobytes())
            segments = np.array(segments, np.int32)
            columns = [
                *batch.select(names).take(pa.array(rows, pa.int64())).columns,
                pa.StringArray.from_buffers(len(ends), borders, data),
                pa.array(segments == 1), pa.array(lasts, pa.bool_()), pa.array(segments), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()),
            ]
            cut = pa.RecordBatch.from_arrays(columns, [*names, *added])
            sent = (np.array(ends, np.int64) - offsets[0]) // OUT
            for part in np.flatnonzero(np.diff(sent, prepend=-1)).tolist():
                yield cut.slice(part, int(np.searchsorted(sent, sent[part], "right")) - part)

    return records.mapInArrow(
        run, f"{fields(others)}, data string, first boolean, last boolean, segment int, payload_bytes long, payload_digest string"
    )


def joined_digests(segments: DataFrame) -> DataFrame:
    """A row for each record of segments, without its data, with payload_bytes and payload_digest. The segments of a
    record must follow each other in a partition, marked by first and last; only the running digest is carried between."""
    out = segments.drop("data")
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            sums, sizes = [], []
            flags = (batch.column(c).to_pylist() for c in ("first", "last"))
            for data, first, last in zip(batch.column("data"), *flags, strict=True):
                if first:
                    digest, n = hashlib.sha256(), 0
                data = data.as_buffer()
                digest.update(data)
                n += data.size
                sums.append(digest.hexdigest() if last else "")
                sizes.append(n)
            columns = [*batch.select(names).columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "payload_bytes", "payload_digest"]).filter(batch.column("last"))

    return segments.mapInArrow(run, f"{fields(out)}, payload_bytes long, payload_digest string")


def record_types(records: DataFrame, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, mark, payload_bytes, payload_digest, record_type, refers_to) of each different (id, payload).

    Of the records that share a payload of at least `least` bytes, those with the smallest id are responses, the rest
    revisits that refer to it; a record without an id is a response only where no other has its payload."""
    sums = written(record_digests(records.select("id", "mark", payload), payload), "digests").distinct()
    heads = (
        sums.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND head IS NOT NULL")
        .select("payload_digest", "head")
    )
    sums = sums.join(heads, "payload_digest", "left")
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return sums.select(
        "id", "mark", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to"),
    )


def write_warc(
    rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, compression: str = "gzip"
) -> None:
    """Writes a WARC record for each row: `response`, or `revisit` of the record with the same payload and smallest id.

    Null payloads are empty, null ids and urls are left out of the headers, repeated rows are written each time. Other
    columns are ignored. An empty table writes an archive without records."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    records = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"), F.xxhash64(text).alias("mark"))
    types = record_types(records, "payload").withColumnsRenamed({"id": "_id", "mark": "_mark", "payload_bytes": "total_bytes", "payload_digest": "total_digest"})
    records = records.join(types, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).drop("_id", "_mark")
    revisit = F.col("record_type") == "revisit"
    records = records.withColumn("payload", F.when(~revisit, F.col("payload")).otherwise(""))
    segments = chunk_rows(records, "payload", chunk)

    crlf = F.lit("\r\n")
    name = F.concat(F.lit("<urn:row:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex("mark")), F.lit(">"))
    refers = F.concat(F.lit("<urn:row:"), F.col("refers_to").cast("string"), F.lit(":"), F.lower(F.hex("mark")), F.lit(">"))
    more = F.col("segment") > 1
    whole = F.col("first") & F.col("last")
    header = lambda key, value: F.concat(crlf, F.lit(key + ": "), value)  # noqa: E731  null, so left out, where value is
    http = F.when(
        ~more & ~revisit,
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("total_bytes").cast("string"), F.lit("\r\n\r\n")),
    ).otherwise("")
    size = F.octet_length(http) + F.octet_length("data")
    record = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(more, "continuation").otherwise(F.col("record_type")),
        header("WARC-Record-ID", F.when(more, F.concat(F.lit("<urn:segment:"), F.lower(F.hex("mark")), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.col("segment").cast("string"), F.lit(">"))).otherwise(name)),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        header("Row-ID", F.col("id").cast("string")),
        F.when(
            revisit,
            F.concat(
                header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                header("WARC-Refers-To", refers),
                header("Refers-To-Row-ID", F.col("refers_to").cast("string")),
            ),
        ),
        header("WARC-Segment-Number", F.when(~whole, F.col("segment").cast("string"))),
        header("WARC-Segment-Origin-ID", F.when(more, name)),
        header("WARC-Segment-Total-Length", F.when(more & F.col("last"), F.col("total_bytes").cast("string"))),
        header("WARC-Payload-Digest", F.when(~more, F.concat(F.lit("sha256:"), F.col("total_digest")))),
        header("Payload-Length", F.when(~more, F.col("total_bytes").cast("string"))),
        header("Payload-Digest-So-Far", F.when(~whole, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        header("Content-Type", F.when(~more & ~revisit, F.lit("application/http; msgtype=response"))),
        header("Content-Length", size.cast("string")),
        F.lit("\r\n\r\n"),
        http,
        F.col("data"),
        F.lit("\r\n\r"),
    )
    segments.select(record.alias("value")).write.option("compression", compression).option("lineSep", "\n").text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record or segment of the archives: its headers that this module writes, and data (binary), whose
    length must be what the header says."""
    raw = spark.read.schema("value string").option("lineSep", NEXT_RECORD).text(path)
    head = F.substring_index("value", "\r\n\r\n", 1)
    raw = raw.select(F.str_to_map(F.regexp_replace(head, r"^(WARC/1\.1\r)?\n", ""), F.lit("\r\n"), F.lit(": ")).alias("h"), F.substring(F.col("value"), F.length(head) + 5, F.length("value")).alias("rest"))
    get = lambda key: F.col("h").getItem(key)
    http = F.when(get("Content-Type").startswith("application/http"), F.octet_length(F.substring_index("rest", "\r\n\r\n", 1)) + 4).otherwise(0)
    size = get("Content-Length").cast("int")
    enough = F.octet_length("rest") >= size
    data = F.when(enough, F.substring(F.encode("rest", "UTF-8"), http + 1, size - http)).otherwise(F.raise_error(F.lit("a WARC record ends early")))
    more = get("WARC-Type") == "continuation"
    return raw.select(
        get("WARC-Type").alias("warc_type"),
        F.when(more, get("WARC-Segment-Origin-ID")).otherwise(get("WARC-Record-ID")).alias("record"),
        get("WARC-Target-URI").alias("url"),
        get("Row-ID").cast("long").alias("id"),
        get("Refers-To-Row-ID").cast("long").alias("refers_to"),
        F.coalesce(get("WARC-Segment-Number").cast("int"), F.lit(1)).alias("segment"),
        get("WARC-Segment-Number").isNull().alias("whole"),
        get("WARC-Segment-Total-Length").cast("long").alias("total"),
        F.substring_index(get("WARC-Payload-Digest"), ":", -1).alias("declared_digest"),
        get("Payload-Length").cast("long").alias("declared_bytes"),
        data.alias("data"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each record, measured from the archives' data; for
    revisits as declared. Raises where a payload is not the one that its header declares."""
    rows = read_segments(spark, path)
    whole = rows.where("whole")
    whole = whole.withColumns({
        "payload_bytes": F.when(F.col("warc_type") == "revisit", F.col("declared_bytes")).otherwise(F.octet_length("data")),
        "payload_digest": F.when(F.col("warc_type") == "revisit", F.col("declared_digest")).otherwise(F.sha2("data", 256)),
    })
    # Segments of one record meet in one task, in order; its memory holds a batch of segments, never the record.
    parts = rows.where("NOT whole").select("record", "warc_type", "id", "refers_to", "declared_digest", "declared_bytes", "data", (F.col("segment") == 1).alias("first"), F.col("total").isNotNull().alias("last"), F.col("segment").alias("no"))
    heads = parts.where("first").select("record", F.col("declared_digest").alias("d"), F.col("declared_bytes").alias("b"))  # repeated rows keep their number here
    parts = parts.drop("declared_digest", "declared_bytes").dropDuplicates(["record", "no"]).repartition("record").sortWithinPartitions("record", "no")
    done = joined_digests(parts)
    done = done.join(heads, "record").select(
        F.lit("response").alias("warc_type"), "id", "refers_to", F.col("d").alias("declared_digest"), F.col("b").alias("declared_bytes"), "payload_bytes", "payload_digest"
    )
    both = whole.select(*done.columns).unionByName(done)
    same = (F.col("declared_digest") == F.col("payload_digest")) & (F.col("declared_bytes") == F.col("payload_bytes"))
    return both.select(
        "id", "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload is not the one declared"))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), "refers_to",
    )


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as its archives have them."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(spark, path).withColumnRenamed("id", "page_id")


#: What DuckDB makes of the pages.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM h
"""
