"""Fill-in-the-middle over relational units.

A text's units (code points, or matches of any pattern that leaves no gaps) are taken in strides of STRIDE of them, one
row for each stride. A window sums up the units and the code points before each stride; cut requests (document, cut, unit
ordinal) are joined to the stride that holds the ordinal; a document's offsets are aggregated to one row, and substrings
make the parts. Strides keep rows to 1 for STRIDE units; the units within a stride that holds a cut are counted in it.

The text rides on its document's first stride alone, so it is shuffled once, by the key that serves the window, the join
and the aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A code point, as a unit; units of a stride.
CODE_POINT, STRIDE = r"(?s:.)", 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred: documents that stay as they are, and of the others those whose suffix comes first.
PLAIN, SPM = 10, 20


def draws(id_col: str, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of an id; a null id counts as an empty one."""
    hexes = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def marked(text: Column) -> Column:
    """Whether a text holds a marker, and so cannot be put together again from what it is turned into."""
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. Markers are found from the left: the texts hold none, and
    none can begin within another."""
    after = lambda x, skip: F.substring(x, F.lit(1) + skip, F.length(x))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(output, second, 1)
        rest = after(output, F.length(one) + len(second))
        two = F.substring_index(rest, MIDDLE, 1)
        return after(one, F.lit(len(first))), two, after(rest, F.length(two) + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    spm_suffix, spm_prefix, spm_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)


def strides(rows: DataFrame, unit: str = CODE_POINT, stride: int = STRIDE) -> DataFrame:
    """(key, pos, units, chars, id, text, copies, before, chars_before) for rows (key, id, text, copies): the strides of
    each text, at least one; id, text and copies on the first alone; units and code points before each."""
    matches = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{stride}}}"), F.lit(0))
    cut = rows.select("*", F.posexplode_outer(matches).alias("at", "said"))
    pos = F.coalesce("at", F.lit(0))
    first = lambda c: F.when(pos == 0, F.col(c)).alias(c)
    cut = cut.select("key", pos.alias("pos"), F.coalesce(F.regexp_count("said", F.lit(unit)), F.lit(0)).cast("long").alias("units"), F.coalesce(F.length("said"), F.lit(0)).cast("long").alias("chars"), first("id"), first("text"), first("copies"))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumns({"before": F.coalesce(F.sum("units").over(before), F.lit(0)), "chars_before": F.coalesce(F.sum("chars").over(before), F.lit(0))})


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, stride: int = STRIDE, seed: str = "1:") -> DataFrame:
    """id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output of each row.

    unit: a pattern whose matches, one after the other, make up every text. A null text counts as an empty one; an empty
    text, one that holds a marker and PLAIN of a hundred stay plain. A null id draws as an empty one; repeated rows have
    equal results and all come back. Other columns are ignored; an empty table gives an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    docs = docs.select(F.col(id_col).alias("id"), text)
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))).alias("key")
    # Equal rows are one here, with a count; the exchange by key is the only one that carries texts.
    rows = docs.select(key, "id", "text").groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    h1, h2, h3, h4 = draws("id", seed)
    n = F.regexp_count(F.col("text"), F.lit(unit)).cast("long")
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - PLAIN), "plain").when(h4 % 100 < SPM, "spm").otherwise("psm")
    asked = docs.select(key, "id", n.alias("n"), marked(F.col("text")).alias("marked")).distinct()
    asked = asked.select("key", "n", form.alias("form"), F.array_sort(F.array(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))).alias("cuts"))
    requests = asked.select(F.col("key").alias("of"), "n", "form", F.posexplode("cuts").alias("cut", "ordinal"))

    cut = strides(rows, unit, stride)
    inside = ((F.col("ordinal") > F.col("before")) & (F.col("ordinal") <= F.col("before") + F.col("units"))) | ((F.col("ordinal") == 0) & (F.col("pos") == 0))
    # The stride's row meets its document's two requests; those elsewhere are null, and the first stride keeps the text.
    met = cut.join(requests.hint("merge"), F.col("key") == F.col("of"))
    place = F.when(inside, F.struct(F.col("chars_before").alias("start"), "chars", (F.col("ordinal") - F.col("before")).alias("left")))
    one = met.groupBy("key").agg(
        F.max("id").alias("id"), F.max("text").alias("text"), F.max("copies").alias("copies"), F.max("n").alias("n"), F.max("form").alias("form"),
        *(F.max(F.when(F.col("cut") == i, place)).alias(f"place{i}") for i in (0, 1)),
    )

    def offset(i: int) -> Column:
        p = F.col(f"place{i}")
        said = F.substring(F.col("text"), (p["start"] + 1).cast("int"), p["chars"].cast("int"))
        return (p["start"] + F.when(p["left"] == 0, 0).otherwise(F.length(F.regexp_substr(said, F.concat(F.lit(f"^(?:{unit}){{"), p["left"].cast("string"), F.lit("}")))))).cast("int")

    at = one.withColumns({"a": offset(0), "b": offset(1)})
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("a")), F.substring(text, F.col("a") + 1, F.col("b") - F.col("a")), F.substring(text, F.col("b") + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    told = lambda x: F.when(F.col("form") != "plain", x.cast("long"))
    out = at.select("id", "n", "form", told(F.col("a")).alias("prefix_chars"), told(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each document."""
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP13_SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
numbers AS (SELECT doc_id, t, n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d4 FROM drawn),
formed AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 90 THEN 'plain' WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                     WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
                     ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM formed
"""
