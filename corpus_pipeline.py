"""The corpus pipeline: `documents` through five stages, each over all that the one before kept.

Toxic documents go; of near-duplicates the one with the smallest id stays; documents that hold a benchmark item go;
personal data, and terms that disclose it, are replaced in what is left; then every text is encoded. Each stage's rows are
written as Parquet in the shared folder and read again by the next.

Columns that documents have besides are kept; those named in pii.RESERVED give way in the stage pii. Rows without an id or
a text are rows like any other, a table without rows stays one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.pieces import encode_and_decode
from tidemark.llm.pii import sanitise
from tidemark.llm.resemblance import near_copies
from tidemark.llm.toxicity import toxicity
from tidemark.session import on_workers


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key of the whole row, never null, by which decisions are carried back: ids may be missing or shared. Its
    name is none of the columns'; of maps, which have no order, the key takes nothing."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    told = [F.struct(F.col(f"`{f.name}`").isNull(), f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.withColumn(name, F.xxhash64(*told)), name


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in gone, with the columns that they came with."""
    return docs.join(gone.select(key).distinct(), key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not scored as toxic, with or without an id."""
    on_workers(spark)
    docs, key = keyed(docs)
    toxic = toxicity(docs, table(spark, sf_dir, "labels"), key_col=key).where("predicted = 1").withColumnRenamed("key", key)
    return without(docs, key, toxic)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id (of repeated rows one); of texts without words,
    which are all alike, one. Rows without an id come last, by their key.

    Near-duplicates here have 0.8 or more of their distinct five-word shingles in common, checked exactly; links chain."""
    on_workers(spark)
    docs, key = keyed(docs)
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = near_copies(ids, [key, "doc_id"])
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", key)
    least = found.groupBy("root").agg(F.min(first)[key].alias("least"))
    others = found.join(least, "root").where(F.col(key) != F.col("least"))
    return without(docs.dropDuplicates([key]), key, others)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found, with or without an id."""
    on_workers(spark)
    docs, key = keyed(docs)
    hit = contaminated(docs, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("id").alias(key)).distinct()
    return without(docs, key, written(hit, "contaminated"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text sanitised and n_chars, where there is such a column, counted anew."""
    rows = sanitise(docs).withColumn("text", F.col("sanitised"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*(f"`{c}`" for c in docs.columns if c in rows.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    import public_tokenizers

    on_workers(spark)
    rows = encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
