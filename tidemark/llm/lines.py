"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table (line, docs): hashes of lines in sorted order, each with the documents that hold it, in buckets by hash.
A batch's counts are merge-anti-joined with every run: lines that a run has already settled (in `least` documents or
more) need no more counting. What remains becomes a run of its own at level 0. Whenever a level has `fanout` runs, they are
merged to one of the level above, so n batches leave some fanout * log(n) runs. Since runs and batch lie in the same
buckets, the runs are never shuffled for a join.

Lines and texts are named by MD5, 128 bits."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

#: Documents in which a line is common; code points that a key has at least.
LEAST, SHORTEST = 10, 1
#: Runs of a level before they are merged; batches that a table is taken in.
FANOUT, BATCHES = 4, 8
#: A line, or a text, that has 1 of HOT rows of a batch, or of all, is hot: there are at most HOT of them.
HOT, SALTS = 4096, 64
WHITE = " \t\n\x0b\x0c\r"
#: Columns that the operator adds or works with; a table's own columns of these names give way.
RESERVED = {"n_lines", "n_dropped", "kept", "_row", "_text", "_hot", "_salt", "_gone", "_lines"}


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lines_of(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(row, pos, line, n): the lines of each different text, and the documents that have this text. Lines whose key has
    fewer than `shortest` code points are left out."""
    text = _text(text_col)
    rows = docs.select(_digest(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "said"))
    rows = rows.select("row", "pos", line_key(F.col("said")).alias("key")).where(F.length("key") >= shortest)
    return rows.select("row", "pos", _digest(F.col("key")).alias("line")).groupBy("row", "pos", "line").agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """The runs. `folder` and `levels` (names of tables, level by level) are all the state that the driver keeps; with a
    lasting catalogue a later session goes on from them."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT, folder: str | None = None, levels: list[list[str]] | None = None):
        self.spark, self.least, self.fanout, self.levels = spark, least, fanout, [list(x) for x in levels or []]
        self.folder = folder or new_path(spark, "line_runs")
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _run(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "line")
        rows.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _all(self, names: list[str]) -> DataFrame:
        # Files, not tables: a union of bucketed tables is taken to be in buckets itself, and then not grouped across them.
        rows = self.spark.read.schema("line binary, docs long").parquet(*(f"{self.folder}/{name}" for name in names))
        return rows.groupBy("line").agg(F.sum("docs").alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """counts: (line, docs) of documents that are in no run yet, each line once."""
        fresh = counts.select("line", "docs")
        for name in self.names():
            settled = self.spark.table(name).where(F.col("docs") >= self.least).select("line")
            fresh = fresh.join(settled.hint("merge"), "line", "left_anti")
        self._put(0, self._run(fresh))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._run(self._all(names)))
            for old in names:  # the catalogue forgets them; their files stay in the shared folder
                self.spark.sql(f"DROP TABLE {old}")

    def common(self) -> DataFrame:
        """(line): found in at least `least` documents of all batches."""
        return self._all(self.names()).where(F.col("docs") >= self.least).select("line")


def _kept(lines: Column, gone: Column) -> Column:
    """The lines but those at the places in `gone` (in order): the stretches between them, joined."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s))), "\n")


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Every row and column of docs, with n_lines, n_dropped and kept: its text without the lines whose key (stripped,
    A to Z in lower case, `shortest` code points or more) is found in at least `least` documents.

    A null or empty text is one empty line, which stays. Repeated rows are documents of their own and all come back; ids may
    be null or shared; other columns stay, but those named in RESERVED are left out. An empty table gives an empty one."""
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in RESERVED - {id_col, text_col}))
    lines = written(lines_of(docs, text_col, shortest), "lines")
    batch = F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch")
    held = lines.groupBy("row", "line").agg(F.max("n").alias("n"))
    counts = written(held.groupBy(batch, "line").agg(F.sum("n").alias("docs")).sortWithinPartitions("batch"), "counts")
    runs = LineRuns(spark, least, fanout)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i))
    common = written(runs.common(), "common")

    # A line that has 1 of HOT of all has it of some batch, so these are at most HOT * batches.
    totals = counts.groupBy("batch").agg(F.sum("docs").alias("all"))
    hot = counts.join(F.broadcast(totals), "batch").where(F.col("docs") * HOT >= F.col("all")).select("line").distinct()
    hot = F.broadcast(written(hot, "hot"))
    usual = lines.join(hot, "line", "left_anti").join(common.join(hot, "line", "left_anti").hint("merge"), "line", "left_semi")
    often = lines.join(F.broadcast(common.join(hot, "line", "left_semi")), "line", "left_semi")
    gone = usual.select("row", "pos", "n").unionByName(often.select("row", "pos", "n")).groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("_gone"), F.max("n").alias("n"))
    gone = written(gone, "gone")

    # Of a text that is hot, copies go to SALTS tasks.
    total = docs.count()
    many = gone.select(F.col("row").alias("_row"), "_gone", (F.col("n") * HOT >= total).alias("_hot"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    rows = docs.withColumn("_text", _text(text_col)).withColumn("_row", _digest(F.col("_text")))
    rows = rows.join(F.broadcast(many.where("_hot").select("_row", "_hot")), "_row", "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(0))
    rows = rows.join(many.select("_row", "_gone", F.explode(salts).alias("_salt")).hint("merge"), ["_row", "_salt"], "left")
    rows = rows.withColumn("_lines", F.split("_text", "\n", -1))
    return rows.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_kept(F.col("_lines"), F.col("_gone"))).alias("kept"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    rows = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line,
         translate(trim(list_extract(parts, pos), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) AS a) AS b),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.key IS NOT NULL AS gone FROM lines AS l LEFT JOIN common AS c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
