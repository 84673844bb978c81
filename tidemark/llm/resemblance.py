"""Near-duplicates by the Jaccard similarity of texts' distinct five-word shingles, checked exactly.

Two leads name the candidates. The first is the SimHash of the shingles and its anchor-point covering (simhash.py): it
leads to the copies with few edits. At a similarity of 0.8, however, fingerprints of 64 bits differ by 9.7 bits on average,
and only 3 to 5 % of such pairs by the 4 bits that anchors cover; a radius of 18, which would find them all, would bring
each fingerprint to half of all anchors. So min-hashes lead to the rest: a text has BANDS keys, each of ROWS min-hashes of
its shingle set, and texts that share a key are candidates. A pair of similarity s shares none with probability
(1 - s^ROWS)^BANDS, 5 in a million at 0.8, wherever the texts differ: in words edited here and there, in a passage
appended or cut.

Texts that share a key are first compared by signatures, a byte of each of SIGNS min-hashes: a pair of 0.8 agrees in fewer
than ALIKE of them with probability 1 in 10 million, texts that have a boilerplate of a third in common hardly ever reach
it. What passes in some key joins texts to pools, directly or by way of others; within each pool all pairs are compared on
their whole shingle sets, and those of 0.8 or more are linked. Keys with many texts and large pools are cut into blocks,
and a task compares two blocks, so it holds neither."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .decontaminate import SHINGLE, SIMILAR, _mixed, shingle_hashes, word_hashes, words_of
from .simhash import RADIUS, majority, near_links

#: Keys of a text, and min-hashes in each.
BANDS, ROWS = 40, 6
#: Min-hashes of a signature, and how many of them texts have in common that are looked at whole.
SIGNS, ALIKE = 120, 72
#: Texts and shingles of a block.
TEXT_BLOCK, SHINGLE_BLOCK = 1024, 1 << 20
_MASKS, _FACTORS = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingle_set(data: bytes) -> np.ndarray:
    """The different hashes of each SHINGLE words in a row of a text's UTF-8; of all words where there are fewer."""
    words = words_of(data)
    return np.unique(shingle_hashes(word_hashes(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """Names a shingle set."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), 42), "big", signed=True)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[i : i + 256] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return least


def band_keys(shingles: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """BANDS keys; none of an empty set, which nothing but an empty one is similar to."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = min_hashes(shingles) if least is None else least
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    return _mixed(least[:SIGNS]).astype(np.uint8).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(column)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 512):
            batch = whole.slice(i, 512)
            sets = _sets(batch, batch.num_columns - 1)
            least = [min_hashes(s) if len(s) else None for s in sets]
            signs = pa.array([None if x is None else signature(x) for x in least], pa.binary())
            columns = [*batch.columns[:-1], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), _lists([band_keys(s, x) for s, x in zip(sets, least, strict=True)]), signs]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "node", "n", "fp", "bands", "signs"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 512):
            sets = _sets(whole.slice(i, 512), 0)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), _lists(sets)], ["node", "shingles"])


def _joined(signs: np.ndarray, home: np.ndarray, came: np.ndarray) -> np.ndarray:
    """For each text the first text of its group, where texts at home are compared with those that came."""
    group = np.arange(len(signs))
    there = np.flatnonzero(came)
    for i in np.flatnonzero(home).tolist():
        alike = there[(signs[there] == signs[i]).sum(axis=1) >= ALIKE]
        joined = np.unique(group[alike])
        if len(joined) and (joined != group[i]).any():
            group[np.isin(group, [*joined.tolist(), group[i]])] = min(int(joined[0]), int(group[i]))
    return group


def _alike(cell: pa.Table) -> pa.Table:
    """A forest of the pairs of a key's texts whose signatures agree, of all keys in a cell."""
    band, node, home, came = (cell.column(c).to_numpy() for c in ("band", "node", "home", "came"))
    signs = np.frombuffer(b"".join(cell.column("signs").to_pylist()), np.uint8).reshape(-1, SIGNS)
    order = np.argsort(band, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], band[order][1:] != band[order][:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    two = starts[sizes == 2]  # most keys
    a, b = order[two], order[two + 1]
    # Two texts in two blocks of a key meet where one is at home and the other came.
    meet = ((home[a] & came[b]) | (home[b] & came[a])) & ((signs[a] == signs[b]).sum(axis=1) >= ALIKE)
    found = [(node[a[meet]], node[b[meet]])]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        mine = order[s : s + n]
        group = _joined(signs[mine], home[mine], came[mine])
        apart = np.flatnonzero(group != np.arange(n))
        found.append((node[mine[apart]], node[mine[group[apart]]]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def alike(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes (node, signs, bands) that have a key in common and signatures that agree in ALIKE of SIGNS; of the
    pairs of one key enough to connect what such pairs connect."""
    at = nodes.select("node", F.explode("bands").alias("band"))
    sizes = at.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = written(at.join(sizes, "band"), "shared")
    cells = int(max(1, shared.count() // (4 * TEXT_BLOCK), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = F.ceil(F.col("k") / TEXT_BLOCK).cast("int")
    dealt = shared.select("band", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    dealt = dealt.withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(cells))).otherwise(F.col("band")))
    rows = dealt.join(nodes.select("node", "signs"), "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        "band", "node", "signs", "cell", (F.col("blocks") == 1).alias("small"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("home"), (F.col("own") >= F.col("other")).alias("came"),
    )
    return rows.groupBy("cell", "small", "i", "j").applyInArrow(_alike, "a long, b long").distinct()


def pools(nodes: DataFrame) -> DataFrame:
    """(node, pool) of each of nodes (node, n, fp, bands, signs) that a lead joins to another: by fingerprints within RADIUS
    bits, or by a key and signatures alike. All that are joined so, and by way of others, have one pool."""
    joined = near_links(nodes.where("n > 0").select("node", "fp"), RADIUS).unionByName(alike(nodes))
    roots = connected_components(joined).withColumnRenamed("root", "pool")
    return roots.unionByName(roots.select(F.col("pool").alias("node"), "pool").distinct())


def _links(cell: pa.Table) -> pa.Table:
    """A forest of the links between the texts at home in a cell and those that came: each pair is checked exactly, by
    adding up over each text's shingles the texts that have them too."""
    nodes, home, came = (cell.column(c).to_numpy() for c in ("node", "home", "came"))
    sizes = pc.list_value_length(cell.column("shingles")).to_numpy().astype(np.int64)
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in cell.column("shingles").chunks])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    mine, own = values[came[owner]], owner[came[owner]]
    order = np.argsort(mine, kind="stable")
    mine, own = mine[order], own[order]
    asked, who = values[home[owner]], owner[home[owner]]
    low, high = np.searchsorted(mine, asked, "left"), np.searchsorted(mine, asked, "right")
    shared = high - low > came[who]  # by another text than itself
    low, n, who = low[shared], (high - low)[shared], who[shared]
    group = np.arange(len(nodes))
    docs, starts = np.unique(who, return_index=True)
    for d, s, e in zip(docs.tolist(), starts.tolist(), np.append(starts, len(who))[1:].tolist(), strict=True):
        k = n[s:e]
        at = np.repeat(low[s:e] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        both = np.bincount(own[at], minlength=len(nodes))
        alike = (both > 0) & (both >= SIMILAR * (sizes[d] + sizes - both) - 1e-9)
        joined = np.unique(group[alike])
        if (joined != group[d]).any():
            group[np.isin(group, [*joined.tolist(), group[d]])] = min(int(joined[0]), int(group[d]))
    found = np.nonzero(group != np.arange(len(nodes)))[0]
    return pa.table({"a": pa.array(nodes[found], pa.int64()), "b": pa.array(nodes[group[found]], pa.int64())})


def exact_links(sets: DataFrame, pooled: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes that connect all of one pool whose similarity is 0.8 or more. sets: (node, shingles), each
    node once; pooled: (node, n, pool) with the number of shingles."""
    sizes = pooled.groupBy("pool").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("texts") / TEXT_BLOCK), F.ceil(F.col("all") / SHINGLE_BLOCK)).cast("int")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    # Pools of one block are dealt together to cells of about a block: that only adds pairs that are checked too.
    cells = int(max(1, total // (SHINGLE_BLOCK // 4), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sizes = sizes.select("pool", blocks.alias("blocks"))
    dealt = pooled.join(sizes, "pool").select(
        "node",
        "blocks",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("pool"), F.lit(cells))).otherwise(F.col("pool")).alias("cell"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"),
    )
    rows = sets.join(dealt, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        "node", "shingles", "cell", (F.col("blocks") == 1).alias("small"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("home"), (F.col("own") >= F.col("other")).alias("came"),
    )
    return rows.groupBy("cell", "small", "i", "j").applyInArrow(_links, "a long, b long")


def near_copies(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(*keys, root) of each row of docs: rows have one root where links of similarity 0.8 or more join their texts.

    keys: columns of longs. Texts with the same shingles belong together, those without words (null, empty) too. Other
    columns are ignored."""
    text = F.col(text_col).cast("string").alias("_text")
    kinds = ", ".join(f"`{k}` long" for k in keys)
    prints = written(docs.select(*keys, text).mapInArrow(_prints, f"{kinds}, node long, n long, fp long, bands array<long>, signs binary"), "prints")
    nodes = written(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("signs").alias("signs")), "nodes")
    pooled = written(pools(nodes).join(nodes.select("node", "n"), "node"), "pooled")
    sets = docs.select(text).mapInArrow(_shingles, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    roots = connected_components(exact_links(sets, pooled))
    return prints.select(*keys, "node").join(roots, "node", "left").select(*keys, F.coalesce("root", "node").alias("root"))
