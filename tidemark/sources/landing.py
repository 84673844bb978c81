"""Landed files in and reports out: venue payloads, configuration, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = ("candidate", "event_id", "market_1", "market_2")
QUOTE = "ticker string, yes_bid double, yes_ask double, open_interest double, volume double"


def price_map(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(ticker, yes_bid, yes_ask, yes, open_interest, volume) of each market in JSON event payloads; yes is the ask, else the
    bid; rows whose price lies outside [0, 1] are left out."""
    markets = payloads.select(F.explode(F.from_json(F.col(column), f"struct<markets:array<struct<{QUOTE.replace(' ', ':').replace(',:', ',')}>>>")["markets"]).alias("m")).select("m.*")
    return markets.withColumn("yes", F.coalesce("yes_ask", "yes_bid")).where(F.col("yes").between(0, 1))


def outcome_prices(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(question, outcome, price) from payloads whose outcomes and prices are JSON lists written as strings."""
    kind = "struct<markets:array<struct<question:string,outcomes:string,outcomePrices:string>>>"
    m = payloads.select(F.explode(F.from_json(F.col(column), kind)["markets"]).alias("m")).select("m.*")
    pairs = F.arrays_zip(F.from_json("outcomes", "array<string>").alias("outcome"), F.from_json("outcomePrices", "array<string>").alias("price"))
    return m.select("question", F.explode(pairs).alias("p")).select("question", "p.outcome", F.col("p.price").try_cast("double").alias("price")).where(F.col("price").between(0, 1))


def merge_histories(daily: DataFrame, minute: DataFrame) -> DataFrame:
    """(t, p) of both, the finer history where both have a time."""
    from pyspark.sql import Window

    both = daily.withColumn("_f", F.lit(1)).unionByName(minute.withColumn("_f", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("t").orderBy("_f", "p"))).where("_n = 1").select("t", "p")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The configured pairs: JSON, each of the four strings there and not empty."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in PAIR)).option("multiLine", True).json(path)
    return rows.where(" AND ".join(f"length(trim({c})) > 0" for c in PAIR))


def frontier(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs of both; a configured pair stands before a stored one of the same key."""
    from pyspark.sql import Window

    both = configured.withColumn("_s", F.lit(0)).unionByName(stored.withColumn("_s", F.lit(1)))
    first = Window.partitionBy("market_1", "market_2").orderBy("_s", "candidate", "event_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_s")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
