"""Columns that are worked out once for each different value."""

from pyspark.sql import functions as F

from tidemark.operators.distinct import once_each


def test_once_for_each_value(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return None if x is None else x.upper()

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"t{i % 3}") for i in range(600)], "id int, title string")
    got = once_each(rows, ["title"], lambda named: named.withColumn("t", F.udf(costly, "string")("title"))).collect()
    assert sorted((r.id, r.title, r.t) for r in got) == [(i, None if i % 3 == 0 else f"t{i % 3}", None if i % 3 == 0 else f"T{i % 3}") for i in range(600)]
    assert seen.value <= 6


def test_once_each_where_the_new_column_is_asked_for(spark):
    """A condition on the new column is not worked out for each row."""
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x.upper()

    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(600)], "id int, title string")
    got = once_each(rows, ["title"], lambda named: named.withColumn("t", F.udf(costly, "string")("title"))).where("t IS NOT NULL AND t <> 'T1'")
    assert got.count() == 400
    assert seen.value <= 6
