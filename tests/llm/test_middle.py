"""Fill-in-the-middle against a plain version, and its round trip."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import middle as M


def plain(i, text, unit):
    text = text or ""
    units = re.findall(unit, text)
    assert "".join(units) == text
    n = len(units)
    hexes = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    odd = ["", None, "a", "<P", "<", "S>", "x<P>y", "<M>", "a<<S", "\n\r\n", "📦é\u0301日本 \u2028 x", "\x00b", "y" * 4000, "w " * 3000, "📦" * 1500]
    out = [(i, t) for i in range(12) for t in odd]
    out += [(i, "".join(rnd.choice("ab <>PSM\n📦é") for _ in range(rnd.randrange(0, 40)))) for i in range(100, 300)]
    return out + [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (7, None), (7, "")]


@pytest.mark.parametrize("unit,regex,stride", [(M.CODE_POINT, r"(?s:.)", 512), (M.CODE_POINT, r"(?s:.)", 1), (M.CODE_POINT, r"(?s:.)", 7), (r"\S+|\s+", r"(?a:\S+|\s+)", 3)])
def test_as_plain(spark, rows, unit, regex, stride):
    if unit != M.CODE_POINT:  # Java's white space: ASCII alone
        regex = r"[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+"
    docs = spark.createDataFrame([(i, t, 1, "clash", "k") for i, t in rows], "doc_id long, text string, n int, form string, key string")
    found = M.fill_in_middle(docs, unit=unit, stride=stride).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r[c] for c in ("id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in found.collect()), key=str)
    assert got == sorted((plain(i, t, regex) for i, t in rows), key=str)
    assert sorted(r["back"] for r in found.collect()) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
