"""Proposals of pairs: every pair of a block is weighed and decided upon, and what is written is chosen in order, each
choice taking from those after it what they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Writes of a block, equivalent and proxy proposals of a run.
PER_BLOCK, MOST_EQUIVALENT, MOST_PROXY = 50, 200, 200
#: Rows of either side of a block that meet in one task.
CELL = 512


def block_pairs(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, cell: int = CELL) -> DataFrame:
    """All pairs of a block. A block with more than `cell` rows of a side is cut into a grid, so that no task holds more
    than about cell by cell pairs of one, and a hot block is dealt to many tasks. The sides' other columns must differ."""

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(name))

    grid = parts(left, "_gl").join(parts(right, "_gr"), block)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(grid, block).withColumn("_i", own(left_id, "_gl")).withColumn("_j", all_of("_gr")).drop("_gl", "_gr")
    b = right.join(grid, block).withColumn("_j", own(right_id, "_gr")).withColumn("_i", all_of("_gl")).drop("_gl", "_gr")
    return a.join(b, [block, "_i", "_j"]).drop("_i", "_j")


def first_come(items: DataFrame, block: str = "block", at: str = "at") -> DataFrame:
    """The items that are taken when each block's are gone through by `at` (different within a block): an item is taken
    unless one taken before it touches a key that it needs. items: block, at, needs and touches (arrays of strings), and
    more.

    Nothing goes through a block. In each round every item is taken that no undecided item before it can touch, and what the
    taken ones touch removes items after them; rounds are as many as the longest chain of items that wait for each other,
    and each is groupings and joins by (block, key)."""
    columns = items.columns
    waiting = written(items, "waiting")
    taken = None

    def earliest(rows: DataFrame) -> DataFrame:
        return rows.select(block, at, F.explode("touches").alias("_key")).groupBy(block, "_key").agg(F.min(at).alias("_first"))

    def met(rows: DataFrame, touched: DataFrame) -> DataFrame:
        """Rows with _met: whether a key that they need is touched by an item before."""
        needs = rows.select(block, at, F.explode_outer("needs").alias("_key")).join(touched, [block, "_key"], "left")
        hit = needs.groupBy(block, at).agg(F.max(F.coalesce(F.col("_first") < F.col(at), F.lit(False))).alias("_met"))
        return rows.join(hit, [block, at])

    while True:
        judged = written(met(waiting, earliest(waiting)), "judged")
        free = judged.where("NOT _met").select(*columns)
        taken = free if taken is None else taken.unionByName(free)
        rest = met(judged.where("_met").select(*columns), earliest(free))
        waiting = written(rest.where("NOT _met").select(*columns), "waiting")
        if waiting.isEmpty():
            return taken


def capped_run(
    taken: DataFrame, block: str = "block", at: str = "at", counted: str = "counted", per_block: int = PER_BLOCK, most: dict[str, int] | None = None
) -> DataFrame:
    """The items of a run that goes through blocks by name and each block's items by `at`: a block ends at per_block of them,
    the run ends where one of the counts in `most` (values of `counted`; null counts for none) is full.

    The end lies among the first sum(most) counted items, so those few alone are looked at in order."""
    most = most or {"equivalent": MOST_EQUIVALENT, "proxy": MOST_PROXY}
    kept = taken.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy(at))).where(F.col("_n") <= per_block).drop("_n")
    kept = written(kept, "kept")
    first = kept.where(F.col(counted).isin(*most)).select(block, at, counted).orderBy(block, at).limit(sum(most.values()))
    so_far = Window.orderBy(block, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = [F.sum(F.when(F.col(counted) == kind, 1).otherwise(0)).over(so_far) >= n for kind, n in most.items()]
    end = first.select(F.struct(block, at).alias("place"), F.greatest(*(f.cast("int") for f in full)).alias("full")).where("full = 1")
    end = end.agg(F.min("place").alias("_end"))  # one row
    here = F.struct(F.col(block), F.col(at))
    return kept.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (here <= F.col("_end"))).drop("_end")


def run_of(pairs: DataFrame, per_block: int = PER_BLOCK, most: dict[str, int] | None = None) -> DataFrame:
    """What a run writes. pairs: block, direction (0: from venue 1, 1: back), weight, a and b (the ids of venue 1 and 2), kind
    (accepted, equivalent, proxy; others are left out), attach (whether the target is linked already).

    In a block, pairs go by direction, falling weight and ids. A pair is written once. An accepted pair links its source,
    and where that is not attached to a family its target too; a pair whose smaller id has been linked is passed over."""
    pair = F.concat_ws(":", F.lit("pair"), "a", "b")
    listing = lambda x: F.concat_ws(":", F.lit("listing"), x)
    source = F.when(F.col("direction") == 0, F.col("a")).otherwise(F.col("b"))
    linked = F.when(F.col("kind") != "accepted", F.array().cast("array<string>")).when(F.col("attach"), F.array(listing(source))).otherwise(F.array(listing(F.col("a")), listing(F.col("b"))))
    rows = pairs.where(F.col("kind").isin("accepted", "equivalent", "proxy"))
    order = Window.partitionBy("block").orderBy("direction", F.desc("weight"), "a", "b")
    items = rows.withColumns({
        "at": F.row_number().over(order), "needs": F.array(pair, listing(F.least("a", "b"))), "touches": F.concat(F.array(pair), linked),
        "counted": F.when(F.col("kind") != "accepted", F.col("kind")),
    })
    return capped_run(first_come(items), per_block=per_block, most=most).drop("needs", "touches", "counted")
