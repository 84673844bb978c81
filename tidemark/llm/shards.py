"""Sharding by longest processing time: groups that must stay together, largest first, each to the least-loaded shard.

A group is all rows of one text. What the schedule needs of billions of groups is how many there are of each size, so
the heap runs over sizes, not over groups: equal groups that follow each other are dealt in runs, which gives each shard
as many as popping it for each group would. Sizes of 2^11 bytes or more are classed by their first 11 bits (at most 2^10
classes for each power of two, 1/1024 of the size apart), smaller ones are exact; so at most some 55,000 rows reach the
driver whatever the input is. The classes are scheduled with their mean size, then the true loads are measured, and the
exact sizes are dealt on top of those, largest first, which evens out what the means left."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

#: Sizes below this are scheduled by their exact value.
EXACT_BELOW = 1 << 11


def deal(classes: list[tuple[int, float, int]], loads: list[float]) -> list[tuple[int, int, int, int]]:
    """(class, first, last + 1, shard): to which shard the groups of a class go, by their number in the class.

    classes: (class, size, groups), largest size first. loads: what each shard holds already. Ties of load go to the
    smaller shard. Runs: while a class has groups left, the least-loaded shard takes groups until it is the most loaded
    among those that wait, and whole rounds go to all shards at once."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out, shards = [], len(loads)
    for name, size, n in classes:
        at = 0
        while at < n:
            least, most = heap[0][0], max(heap)[0]
            if most - least <= size and n - at >= 2 * shards:
                rounds = (n - at) // shards
                for load, shard in sorted(heap):
                    out.append((name, at, at + rounds, shard))
                    at += rounds
                heap = [(load + rounds * size, shard) for load, shard in heap]
                heapq.heapify(heap)
                continue
            load, shard = heapq.heappop(heap)
            take = min(n - at, max(1, int((heap[0][0] - load) / size)) if heap else n - at)
            out.append((name, at, at + take, shard))
            at += take
            heapq.heappush(heap, (load + take * size, shard))
    return out


def _dealt(groups: DataFrame, loads: list[float]) -> DataFrame:
    """Adds shard to the groups (class, size, key), given the loads so far."""
    sizes = groups.groupBy("class").agg(F.avg("bytes").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted(((r["class"], r["size"], r["n"]) for r in sizes), reverse=True)
    runs = groups.sparkSession.createDataFrame(deal(sizes, loads) or [(-1, 0, 0, 0)], "class long, first long, after long, shard int")
    rows = numbered(groups, "class", ["key"], "place")
    runs = F.broadcast(runs.withColumnRenamed("class", "_class"))
    return rows.join(runs, F.expr("class = _class AND place >= first AND place < after")).select("key", "bytes", "shard")


def lpt_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs: equal texts share a shard, shards have near equal sizes.

    size: UTF-8 bytes of the text plus 1; a null text has none, like an empty one. slot numbers the rows of a shard from
    0 without gaps. Repeated rows each get a slot. Null ids are kept. An empty table gives an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("key"),
    )
    rows = written(rows, "sized")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.col("bytes").cast("double"))).cast("int") - 10)
    groups = written(groups.withColumn("class", _cut("bytes", shift)), "groups")
    large = written(_dealt(groups.where(F.col("class") >= EXACT_BELOW), [0.0] * shards), "large")
    loads = dict.fromkeys(range(shards), 0.0) | {r["shard"]: float(r["n"]) for r in large.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    small = _dealt(groups.where(F.col("class") < EXACT_BELOW), [loads[i] for i in range(shards)])
    placed = written(large.unionByName(small).select("key", "shard"), "placed")
    rows = rows.join(placed, "key")
    return numbered(rows, "shard", ["id", "key"], "slot").select("id", "size", "text_crc32", "shard", "slot")


def _cut(size: str, shift) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(size), shift), shift)


def op8_lpt_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null: that law has none) of each document."""
    rows = lpt_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
