"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when at most `radius` bits differ. The 64 bits are cut into parts so that two linked
fingerprints differ by at most `slack` bits in one part (pigeonhole). In each part the words of a linear covering code
are the anchors. Every fingerprint has one home anchor, within the code's covering radius R; it is replicated to every
anchor within R + slack, and at each anchor the fingerprints at home there are compared, on all 64 bits, with all that
came. If x and y differ by at most `slack` bits in a part, y's home anchor is within R + slack of x, so the pair meets.

What the code decides by (n - k check bits per word) is its table of error patterns by syndrome: the anchors within w of
a word are the word with each pattern of weight at most w of its own syndrome flipped."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Bits that may differ.
RADIUS = 4
#: Fingerprints compared in one group: those at home there, and those that came.
HOME_BLOCK, CAME_BLOCK = 2048, 16384


# ---- fingerprints


def shingle_hashes(words: list[bytes], words_each: int) -> np.ndarray:
    """XXH64 (seed 42) of each words_each words in a row, space-joined; of all words where there are fewer."""
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - words_each + 1].tolist()
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprint_of(data: bytes, words_each: int) -> int:
    """Of one text's UTF-8: lower-cased A-Z, split at ASCII white space; 0 if it has no words."""
    words = data.lower().split()
    return majority(shingle_hashes(words, words_each)) if words else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4) -> DataFrame:
    """(id, fp) for every row; fp is the 64 bits as a long. A null text counts as an empty one, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = [fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", words_each) for t in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# ---- covering codes


class CoveringCode:
    """The linear code of length n whose parity checks are the columns' bits: column i is the syndrome of a word with bit
    i alone. Its covering radius is found by listing error patterns, lightest first, until each syndrome has one."""

    def __init__(self, columns: list[int], slack: int):
        self.n, self.columns = len(columns), np.array(columns, np.int64)
        checks = int(self.columns.max()).bit_length()
        self.home = np.full(1 << checks, -1, np.int64)
        by_weight, seen, self.radius = [], 0, 0
        for w in range(self.n + 1):
            flips = np.array([sum(1 << i for i in c) for c in combinations(range(self.n), w)], np.int64)
            s = self.syndrome(flips)
            new, first = np.unique(s, return_index=True)
            fresh = self.home[new] < 0
            self.home[new[fresh]] = flips[first[fresh]]
            by_weight.append((s, flips))
            if seen < self.home.size and (seen := int((self.home >= 0).sum())) == self.home.size:
                self.radius = w
            if seen == self.home.size and w >= self.radius + slack:
                break
        s, flips = (np.concatenate(x) for x in zip(*by_weight, strict=True))
        order = np.argsort(s, kind="stable")
        self.patterns, self.starts = flips[order], np.searchsorted(s[order], np.arange(self.home.size + 1))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, c in enumerate(self.columns.tolist()):
            out ^= ((words >> i) & 1) * c
        return out

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, at_home) for each word and each anchor within the covering radius plus slack of it."""
        s = self.syndrome(words)
        n = self.starts[s + 1] - self.starts[s]
        row = np.repeat(np.arange(len(words)), n)
        at = np.repeat(self.starts[s] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(row))
        flips = self.patterns[at]
        return row, words[row] ^ flips, flips == self.home[s][row]


def golay_columns(n: int) -> list[int]:
    """Parity checks of the perfect binary (23, 12) Golay code: x^i modulo its generator polynomial. Parts of fewer than
    23 bits are words of it that end in zeros; a code cut to their length would no longer be perfect."""
    generator, column, out = 0b101011100011, 1, []
    for _ in range(23):
        out.append(column)
        column <<= 1
        if column >> 11:
            column ^= generator
    return out


def hamming_columns(n: int) -> list[int]:
    """A Hamming code of 15 bits beside n - 15 bits without a check: covering radius 1, finer anchors."""
    return list(range(1, 16)) + [0] * (n - 15)


#: Below so many different fingerprints the coarser anchors replicate less; above, the finer ones keep groups small.
COARSE_UP_TO = 1 << 23


def parts_of(radius: int, bits: int = 64, most: int = 23) -> tuple[list[tuple[int, int]], int]:
    """The (shift, length) of each part, and the bits by which linked fingerprints differ at most in the best part."""
    m = -(-bits // most)
    lengths = [bits // m + (i < bits % m) for i in range(m)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)], radius // m


# ---- links


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links between the fingerprints at home at an anchor and those that came: (a, b) pairs, at most one
    for each fingerprint. Compared in strips, so that memory stays bounded however many link."""
    at_home = rows["home"].to_numpy(bool)
    home, came = rows[at_home], rows[~at_home]
    column = lambda df, c: df[c].to_numpy(np.int64).view(np.uint64)
    nodes, others = home["node"].to_numpy(np.int64), came["node"].to_numpy(np.int64)
    fp, fp2 = column(home, "fp"), column(came, "fp")
    radius = int(rows["radius"].iloc[0])
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for i in range(0, len(home), 256):
        near = np.bitwise_count(fp[i : i + 256, None] ^ fp2[None, :]) <= radius
        near &= nodes[i : i + 256, None] != others[None, :]
        row, col = np.nonzero(near)
        if not len(row):
            continue
        # Each that came joins the first at home that it links to; those at home that it links to besides join that one.
        first = np.zeros(len(came), np.int64)
        order = np.lexsort((row, col))
        cols, at = np.unique(col[order], return_index=True)
        first[cols] = row[order][at]
        joined = np.unique(row * 256 + first[col])
        pairs = [*zip(others[cols].tolist(), nodes[i + first[cols]].tolist(), strict=True), *zip(nodes[i + joined // 256].tolist(), nodes[i + joined % 256].tolist(), strict=True)]
        for x, y in pairs:
            if (p := root(x)) != (q := root(y)):
                up[max(p, q)] = min(p, q)
    found = [x for x in up if root(x) != x]
    return pd.DataFrame({"a": np.array(found, np.int64), "b": np.array([root(x) for x in found], np.int64)})


def near_links(fps: DataFrame, radius: int = RADIUS, fine: bool | None = None) -> DataFrame:
    """(a, b) pairs of nodes that connect all whose fingerprints are within `radius`. fps: (node, fp), each node once;
    both codes find the same links, and without `fine` the number of nodes decides between them."""
    spark = fps.sparkSession
    fine = fps.count() > COARSE_UP_TO if fine is None else fine
    parts, slack = parts_of(radius)
    columns = hamming_columns if fine else golay_columns
    carried = ["node", "fp"]

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = {n: CoveringCode(columns(n), slack) for _, n in parts}
        for rows in batches:
            for i in range(0, len(rows), 5_000):
                block = rows.iloc[i : i + 5_000]
                fp = block["fp"].to_numpy(np.int64).view(np.uint64)
                for k, (shift, n) in enumerate(parts):
                    word = ((fp >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)
                    row, anchor, at_home = codes[n].anchors(word)
                    head = {"part": np.int32(k), "anchor": anchor.astype(np.int32), "home": at_home}
                    yield pd.DataFrame(head | {c: block[c].to_numpy()[row] for c in carried})

    kinds = "part int, anchor int, home boolean, " + ", ".join(f"{c} long" for c in carried)
    rows = fps.select(*carried).mapInPandas(replicate, kinds)
    # One row for each anchor in use: at most 3 times 2^12 (2^17 if fine), however many fingerprints there are.
    cells = rows.groupBy("part", "anchor").agg(F.count(F.lit(1)).alias("came_n"), F.count_if("home").alias("home_n"))
    cells = cells.where("home_n > 0 AND came_n > 1").select(
        "part", "anchor", F.ceil(F.col("home_n") / HOME_BLOCK).cast("int").alias("hs"), F.ceil(F.col("came_n") / CAME_BLOCK).cast("int").alias("cs")
    )
    rows = rows.join(F.broadcast(cells), ["part", "anchor"])
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["part", "anchor", *carried, F.lit(radius).alias("radius")]
    at_home = rows.where("home").select(*keep, F.lit(True).alias("home"), deal("hs").alias("i"), every("cs").alias("j"))
    came = rows.select(*keep, F.lit(False).alias("home"), every("hs").alias("i"), deal("cs").alias("j"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = at_home.unionByName(came).repartition(n, "part", "anchor", "i", "j")
    return both.groupBy("part", "anchor", "i", "j").applyInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, radius: int = RADIUS, fine: bool | None = None) -> DataFrame:
    """(id, fp, component): for each row of docs its fingerprint and the smallest id that links reach from it.

    Equal fingerprints always belong together, those of texts without words (null, empty) included. A row without an id
    gets the smallest id of its component, null if that has none. Repeated rows each come back. An empty table gives an
    empty one. Other columns are ignored."""
    prints = written(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    groups = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "groups")
    roots = connected_components(near_links(groups.select(F.col("fp").alias("node"), "fp"), radius, fine)).withColumnRenamed("node", "fp")
    of = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(ids, "root").select("fp", "component")
    return prints.join(of, "fp").select("id", "fp", "component")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
