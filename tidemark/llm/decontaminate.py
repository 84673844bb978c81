"""Benchmark decontamination by SimHash over windows as long as the items.

For each length that a benchmark item has in words, the windows of that many words of every document get the SimHash of
their word shingles. A window's candidates are the items of its length whose fingerprint is within RADIUS bits: the
fingerprint is cut into BLOCKS blocks, and where at most RADIUS bits differ, at most RADIUS // BLOCKS do in one block. So
each block has an index of values, and a window looks up what is that near to its own: an item stands under all values
within some bits of its own, a window asks for all values within the other bits of its own, so that they meet. The more
items, the more of the bits are left to the windows; that bounds the index and changes no result. Candidates are verified
exactly: the similarity of two texts is the weighted Jaccard similarity of their shingles, each weighted by how often it
occurs.

Before a window is hashed, two numbers that cost little must allow that similarity: a bitmap of fixed size tells which of
a document's shingles can be in any item at all, and a window needs enough of them. That drops no window that an item is
similar to."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, and the similarity from which a window is contaminated.
SHINGLE, SIMILAR = 5, 0.8
#: Bits of the fingerprints that may differ (at a similarity of 0.8 they are 9.7 on average, with a deviation of 2.9), and
#: the blocks of 16 bits.
RADIUS, BLOCKS = 19, 4
#: Bits of the shingle bitmap (2 MB, however many items there are); items, and bytes of their texts, searched for in one
#: pass over the documents; entries of the index of such a set (of 6 bytes).
BITMAP_BITS, MOST_ITEMS, MOST_BYTES, MOST_ENTRIES = 1 << 24, 50_000, 32 << 20, 1 << 23
#: Pairs of a window and an index entry that are looked at together.
PAIRS = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """Of a text's UTF-8: A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Of each k words in a row, given the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return _mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


def flips(most: int, bits: int = 16) -> np.ndarray:
    """All values of so many bits in which at most `most` are set."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= most].astype(np.uint16)


class BlockIndex:
    """Which of the fingerprints have a 16-bit block within `reach` bits of a given one's, block by block."""

    def __init__(self, prints: np.ndarray, reach: int, own: int):
        """own: of the reach, the bits by which a fingerprint's entries vary; windows vary by the others."""
        near, self.masks, self.lists = flips(own), flips(reach - own), []
        for block in self._blocks(prints):
            values = (block[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.lists.append((values[order], (order // len(near)).astype(np.int32)))

    @staticmethod
    def _blocks(prints: np.ndarray) -> Iterator[np.ndarray]:
        for b in range(BLOCKS):
            yield ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def meets(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, fingerprint) places that meet in some block, some more than once, at most about PAIRS at a time."""
        for block, (values, who) in zip(self._blocks(windows), self.lists, strict=True):
            step = max(1, PAIRS // len(self.masks))
            for i in range(0, len(block), step):
                asked = (block[i : i + step, None] ^ self.masks[None, :]).ravel()
                low = np.searchsorted(values, asked, "left")
                n = np.searchsorted(values, asked, "right") - low
                hit = np.nonzero(n)[0]
                low, n, window = low[hit], n[hit], i + hit // len(self.masks)
                ends = np.cumsum(n)
                cuts = np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS), "right")
                for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if len(ends) else ():
                    if b > a:
                        k = n[a:b]
                        at = np.repeat(low[a:b] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                        yield np.repeat(window[a:b], k), who[at]


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


def shingles(words: list[bytes]) -> Counter:
    k = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Items:
    """The benchmark items of one pass, by their length in words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_length: dict[int, list[tuple[int, Counter]]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        self.bitmap: dict[int, np.ndarray] = {}
        for item, text in items:
            words = words_of(text.encode())
            if not words:
                continue
            k = min(SHINGLE, len(words))
            h = shingle_hashes(word_hashes(words), k)
            self.bitmap.setdefault(k, np.zeros(BITMAP_BITS // 8, np.uint8))
            at = h & np.uint64(BITMAP_BITS - 1)
            np.bitwise_or.at(self.bitmap[k], (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.by_length.setdefault(len(words), []).append((item, shingles(words)))
            prints.setdefault(len(words), []).append(_packed(_bits(h).sum(0, dtype=np.int64)[None], len(h)))
        self.prints = {n: np.concatenate(x) for n, x in prints.items()}
        reach, all_items = RADIUS // BLOCKS, sum(map(len, self.prints.values()))
        own = max((x for x in range(reach + 1) if all_items * BLOCKS * len(flips(x)) <= MOST_ENTRIES), default=0)
        self.index = {n: BlockIndex(p, reach, own) for n, p in self.prints.items()}

    def candidates(self, length: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of each pair within RADIUS bits, in order."""
        prints, found = self.prints[length], [np.empty(0, np.int64)]
        for w, i in self.index[length].meets(windows):
            near = np.bitwise_count(windows[w] ^ prints[i]) <= RADIUS
            found.append(np.unique(w[near] * len(prints) + i[near]))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(prints), pairs % len(prints)

    def search(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): for each item its most similar window of a text, the first of those."""
        words = words_of(text)
        if not words or not self.by_length:
            return []
        hashes, best = word_hashes(words), {}
        for k, bitmap in self.bitmap.items():
            h = shingle_hashes(hashes, k)
            at = h & np.uint64(BITMAP_BITS - 1)
            known = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            if not known.any():
                continue
            before = np.concatenate(([0], np.cumsum(known, dtype=np.int64)))
            ones = None
            for length, items in self.by_length.items():
                if min(SHINGLE, length) != k:
                    continue
                m = min(length - k + 1, len(h))  # a shorter text is one window
                total = m + length - k + 1
                need = SIMILAR / (1 + SIMILAR) * total - 1e-9
                start = np.nonzero(before[m:] - before[:-m] >= need)[0]
                if not len(start):
                    continue
                if ones is None:
                    ones = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(_bits(h), axis=0, dtype=np.int64)))
                for i in range(0, len(start), 4096):
                    s = start[i : i + 4096]
                    for w, j in zip(*self.candidates(length, _packed(ones[s + m] - ones[s], m)), strict=True):
                        first = int(s[w])
                        item, own = items[j]
                        sim = similarity(shingles(words[first : first + m + k - 1]), own)
                        if sim >= SIMILAR and (item not in best or (-sim, first) < best[item][0]):
                            best[item] = ((-sim, first), first, m + k - 1, sim)
        return [(item, first, n, sim) for item, (_, first, n, sim) in best.items()]


#: The index that a worker has built last, under the name of its set.
_BUILT: dict[str, Items] = {}


def _built(name: str, items: list[tuple[int, str]]) -> Items:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(items)
    return _BUILT[name]


def item_sets(items: DataFrame, most_items: int = MOST_ITEMS) -> Column:
    """Names the set of each of items (item, text), so that a set has at most most_items items and MOST_BYTES of text. A text
    of half of that or more is a set of its own. The others are dealt by hash to twice as many sets as would do, and to
    twice as many again while one is too full."""
    hashed, size = F.xxhash64("item", "text"), F.octet_length("text")
    alone = size * 2 > MOST_BYTES
    n, total = items.where(~alone).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    sets = max(1, -(-2 * n // most_items), -(-2 * total // MOST_BYTES)) if n > most_items or total > MOST_BYTES else 1
    while True:
        place = F.when(alone, F.concat(F.lit("alone:"), hashed)).otherwise(F.pmod(hashed, F.lit(sets)).cast("string"))
        held = items.where(~alone).groupBy(place.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
        if held.where((F.col("n") > 1) & ((F.col("n") > most_items) | (F.col("bytes") > MOST_BYTES))).isEmpty():
            return place
        sets *= 2


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_items: int = MOST_ITEMS
) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): for each row of docs and each item that one of its windows is
    similar to, the most similar window.

    Of items without words nothing is said, nor of null or empty texts; a null item id is a name like any other. Repeated
    rows of docs each come back, repeated items once. A text shorter than an item is one window. The items travel to the tasks in sets
    of at most `most_items` and MOST_BYTES of text, one pass over docs for each set. Other columns are ignored; empty tables give an empty one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("length(trim(text)) > 0").distinct()
    place = item_sets(items, most_items)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    kinds, out = "id long, item_id long, first_word long, n_words long, similarity double", None
    for part in [r["part"] for r in items.select(place.alias("part")).distinct().collect()] or [""]:  # one name for each set
        own = items.where(place == part)
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _built(name, shared.value)
            for batch in batches:
                found = [(i, *x) for i, t in enumerate(batch.column(1)) for x in index.search(t.as_buffer().to_pybytes() if t.is_valid else b"")]
                row, *rest = zip(*found, strict=True) if found else ((),) * 5
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds_of, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "first_word", "n_words", "similarity"])

        hits = rows.mapInArrow(run, kinds)
        out = hits if out is None else out.unionByName(hits)
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: every benchmark item found in a document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).withColumnRenamed("id", "doc_id")
