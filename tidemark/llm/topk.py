"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments; the index holds, for each segment, which codes have which value there. Round
r = 0, 1, ... looks up, in every segment, the values that differ from the query's in exactly r bits. After round r every
code within m (r + 1) - 1 bits has been found (by pigeonhole one of its segments is within r), so a query is done once it
has k verified neighbours that near; only queries that are not done go on to the next round.

Each round is a join of the open queries' probes with the index on (segment, value). What is
farther than a query's kth neighbour so far is left out in that join. Codes are indexed once however many
rows have them, with the k smallest ids of those rows: no more can be among a query's first k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 64


def sign_code(vector: str) -> Column:
    """The 64-bit code of a vector of 64 numbers: bit i is 1 where number i is above 0, which NaN is not. Null for a vector
    of another length or with a null in it."""
    # Spark orders NaN above all numbers; here it is none, and not above 0.
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).when(x.isNotNull(), F.lit(0).cast("long"))
    bits = F.transform(F.col(vector).cast("array<double>"), bit)
    return F.when(F.size(vector) == BITS, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments_for(n: int, bits: int = BITS) -> int:
    """So many that a segment has about log2(n) bits: then a probe finds about one code. Segments of fewer than 16 bits
    would save a small table little."""
    return max(2, round(bits / max(math.log2(max(n, 2)), 16)))


def _cuts(m: int, bits: int = BITS) -> list[tuple[int, int]]:
    lengths = [bits // m + (i < bits % m) for i in range(m)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def _values(m: int) -> Column:
    """(segment, value) of each segment of the code."""
    return F.explode(F.array(*(
        F.struct(F.lit(i).alias("segment"), F.call_function("shiftrightunsigned", F.col("code"), F.lit(at)).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (at, n) in enumerate(_cuts(m))
    )))


def _flipped(probes: DataFrame, r: int, m: int) -> DataFrame:
    """A row for each way to flip r bits of a probe's segment, lowest bit first; the tasks that hold the probes make them."""
    others = [c for c in probes.columns if c != "value"]
    length = F.element_at(F.array(*(F.lit(n) for _, n in _cuts(m))), F.col("segment") + 1)
    probes = probes.where(length >= r).withColumn("_last", F.lit(-1))
    for left in range(r, 0, -1):  # so many bits are still to be flipped, each above the last
        probes = probes.select(*others, "value", F.explode(F.sequence(F.col("_last") + 1, length - left)).alias("_last"))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_last"))))
    return probes.drop("_last")


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): for each query the k rows of the smallest Hamming distance, equal ones by id.

    rows and queries: (id long, code long); rows with a null id or code are left out, repeated rows count once, a query
    may find itself. Queries with the same id and code are one. With fewer than k rows, all. Empty tables give an empty
    one."""
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    first = Window.partitionBy("code").orderBy("id")
    # Hot codes: only the k smallest ids of a code go on; Spark drops the others before they are shuffled.
    held = written(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("code", "id"), "held")
    codes = held.select("code").distinct()
    n = codes.count()
    m = segments or segments_for(n)
    index = written(codes.select("code", _values(m).alias("s")).select("code", "s.*"), "index")
    open_ = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    open_ = written(open_.withColumn("bound", F.lit(BITS)), "open")
    longest, done, found = max(n for _, n in _cuts(m)), None, None
    best = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    for r in range(longest + 1):
        probes = open_.withColumn("code", F.col("query")).select("query_id", "query", "bound", _values(m).alias("s")).select("query_id", "query", "bound", "s.*")
        if r:
            # Dealt before they multiply: few open queries have many flips.
            n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            probes = _flipped(probes.repartition(n_tasks, "query_id", "query", "segment"), r, m)
        # A code that is farther than the kth so far is left out where it is met.
        p, x, apart = probes.alias("p"), index.alias("x"), F.bit_count(F.col("p.query").bitwiseXOR(F.col("x.code")))
        hit = (F.col("p.segment") == F.col("x.segment")) & (F.col("p.value") == F.col("x.value")) & (apart <= F.col("p.bound"))
        # Merged: probes are made after the planner has seen their size, so they must never be broadcast.
        near = p.join(x.hint("merge"), hit).select("query_id", "query", "code").distinct()
        near = near.join(held, "code").select("query_id", "query", "id", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        near = near if found is None else near.unionByName(found.join(open_, ["query_id", "query"], "left_semi")).distinct()
        found = written(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "found")
        covered = m * (r + 1) - 1
        full = found.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")).where(F.col("n") >= k)
        ended = found.join(full.where(F.col("kth") <= covered), ["query_id", "query"], "left_semi") if r < longest else found
        done = ended if done is None else done.unionByName(ended)
        if r == longest:
            break
        open_ = open_.drop("bound").join(full, ["query_id", "query"], "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
        open_ = written(open_.select("query_id", "query", F.coalesce("kth", F.lit(BITS)).alias("bound")), "open")
        if not open_.take(1):
            break
    return done.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "id", "distance")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, distance: the 10 nearest sign codes of every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    found = exact_top_k(rows, rows.where("id % 50 = 0"), 10)
    return found.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


OP5_SQL = """
WITH c AS (
  SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS low,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS high
  FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, (bit_count(xor(q.low, r.low)) + bit_count(xor(q.high, r.high)))::INTEGER AS distance
  FROM c q CROSS JOIN c r WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM n WHERE rank <= 10
"""
