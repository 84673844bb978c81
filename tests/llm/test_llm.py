"""The corpus operators against plain versions of themselves, on small and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, base string"
WORDS = ["the", "of", "loser", "and", "été", "naïve", "日本", "x1", "don't", "alpha", "beta", "gamma", "delta", "📦", "Ünder"]


def rows_of(texts, first=0):
    return [(None if i == 3 else first + i, t, "en", "s", None, "clash", 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = ["", None, " ", "a", "a b c", "\t\n", "x " * 3000, "y" * 20_000, "same text here for all of us", "same text here for all of us"]
    base = [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(120)]
    out += [" ".join(base), " ".join(base[:-1]), " ".join(base[:60] + ["changed"] + base[61:])]
    out += [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sql_ids(rows, name="id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is not None, x))


# ---- 1


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_warc_round_trip(spark, tmp_path, chunk):
    from tidemark.llm.warc import read_records, read_segments, write_warc

    long = "é<p>\r\n\r\n" * 60
    trap = "a" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nx" + "\nWARC/1.1\r" * 3 + "b" * 60
    pages = [(1, "http://a b/\n", long), (2, None, long), (0, "u", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", trap), (8, "u", trap), (9, "u", "z" * 1000), (9, "u", "z" * 1000)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, id string, mark int")
    write_warc(df, path := f"file://{tmp_path}/w", chunk=chunk)
    got = sorted(map(tuple, read_records(spark, path).collect()), key=str)
    heads = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            heads[h] = min(i, heads.get(h, i))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = h in heads and heads[h] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", heads[h] if revisit else None))
    assert got == sorted(want, key=str)
    most = read_segments(spark, path).select(F.max(F.octet_length("data"))).first()[0]
    assert most <= 4 * chunk


def test_warc_empty(spark, tmp_path):
    from tidemark.llm.warc import read_records, write_warc

    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert read_records(spark, f"file://{tmp_path}/e").count() == 0


# ---- 2


def test_decontaminate(spark, docs, empty):
    from tidemark.llm.decontaminate import contaminated, shingles, similarity, words_of

    rnd = random.Random(3)
    item = [f"w{rnd.randrange(1000)}" for _ in range(40)]
    items = [(1, " ".join(item)), (2, "one two three"), (3, ""), (4, None), (5, "TWO  words"), (5, "TWO  words"), (None, " ".join(item[:30]))]
    texts = [" ".join(["pad"] * 300 + item + ["pad"] * 9), " ".join(item[:20] + ["new"] + item[20:]), " ".join(item[:37]), "x one two three y", "two WORDS", "one two", None, "", " ".join(item[::-1])]
    d = spark.createDataFrame(rows_of(texts), DOCS)
    got = {(r["id"], r["item_id"]): r["similarity"] for r in contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, (doc, t, *_) in enumerate(rows_of(texts)):
        w = words_of((t or "").encode())
        for item_id, it in items:
            own = words_of((it or "").encode())
            if not own or not w:
                continue
            n = min(len(own), len(w))
            k = min(5, len(own))
            part = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            sims = [similarity(part(w[s : s + n]), part(own)) for s in range(len(w) - n + 1) if len(w) >= k]
            if sims and max(sims) >= 0.8:
                want[doc, item_id] = max(sims)
    assert got == pytest.approx(want)
    assert shingles([b"a"]) == Counter({(b"a",): 1})
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(empty, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(d, bench, most_items=4).count() == len(got)


def test_multi_index_finds_all_within_the_radius():
    from tidemark.llm.decontaminate import RADIUS, Items

    rnd = np.random.default_rng(1)
    items = Items([(i, " ".join(f"t{x}" for x in rnd.integers(0, 500, 30))) for i in range(60)])
    windows = np.concatenate([p ^ (np.uint64(1) << rnd.integers(0, 64, len(p), dtype=np.uint64)) for p in [items.prints[30]] * 3])
    for _ in range(18):
        windows = windows ^ (np.uint64(1) << rnd.integers(0, 64, len(windows), dtype=np.uint64))
    w, i = items.candidates(30, windows)
    near = np.bitwise_count(windows[:, None] ^ items.prints[30][None, :]) <= RADIUS
    assert sorted(zip(w.tolist(), i.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(near).tolist()))


# ---- 3

EM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EM.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans(spark):
    from tidemark.llm.pii import with_base_spans

    rnd = random.Random(6)
    bits = ["a@b.c", "a@b.c_d@e.f.g", "@", ".", "-", "+", " ", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.0255", "4111 1111-1111 1111", "4111111111111111", "4", "12", "+1 (555) 123-4567", "+1", "(", "é", "📦", "x", "%", "_", "5500005555555559", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(1500)] + ["", None, "9" * 30_000, "a" * 30_000, "1 " * 20_000, "1." * 20_000, "+1" * 9_000, "a@b" + ".c" * 9_000, "a.b@" * 5_000]
    rows = with_base_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("text", F.coalesce("t", F.lit(""))))
    for r in rows.select("i", "base").collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base_spans(texts[r["i"]] or ""), texts[r["i"]]


def test_disclosing_terms(spark, docs, empty):
    from tidemark.llm.pii import sanitise

    rnd = random.Random(8)
    texts = [f"Codename Zephyr meets a{i}@b.example with notes by everyone" for i in range(8)]
    texts += ["everyone writes notes with words " + " ".join(rnd.choice(WORDS) for _ in range(5)) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "e", "s", 0, "c", 1, "b") for i, t in enumerate(texts)], DOCS).drop("base")
    rows = {r["doc_id"]: r for r in sanitise(d).collect()}
    assert {t["term"] for t in rows[0]["terms"]} == {"Codename", "Zephyr", "meets"}
    assert rows[0]["sanitised"] == "   [EMAIL] with notes by everyone"
    assert not rows[20]["terms"] and rows[20]["sanitised"] == texts[20]
    rows = sanitise(docs)
    assert rows.count() == docs.count() and dict(rows.dtypes)["base"].startswith("array") and {"id", "key"} <= set(rows.columns)
    assert sanitise(empty).count() == 0


# ---- 4


def test_toxicity(spark, docs, empty):
    from tidemark.llm.toxicity import toxicity

    rnd = random.Random(9)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [rnd.choice(["the", "of", "and", "river", "stone", "cloud"]) + rnd.choice(["", "s", "er"]) for _ in range(20)]
        if toxic:
            words.insert(3, rnd.choice(["dolt", "oaf", "grumbleface"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame([(i, t, "e", "s", 0, "c", 1, "b") for i, t in texts], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in toxicity(d, lab).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) / len(held) > 0.98
    assert toxicity(docs, lab).count() == docs.count()
    assert toxicity(empty, lab).count() == 0
    assert {r["score"] for r in toxicity(docs, lab.limit(0)).collect()} == {0.5}


# ---- 5


def test_top_k(spark):
    from tidemark.llm.topk import exact_top_k, sign_code

    rnd = random.Random(10)
    codes = [rnd.getrandbits(64) - (1 << 63) for _ in range(150)]
    rows = [(i, codes[i] if i < 150 else codes[0]) for i in range(260)] + [(None, 5), (900, None), (3, codes[3])]
    queries = [(1, codes[1]), (2, codes[0]), (7, 0), (7, 0), (None, 1)]
    df = lambda x: spark.createDataFrame(x, "id long, code long")
    got = [tuple(r) for r in exact_top_k(df(rows), df(queries), 4, segments=4).orderBy("query_id", "rank").collect()]
    want = []
    for q, c in sorted({x for x in queries if x[0] is not None}):
        near = sorted({((c ^ r) & (2**64 - 1)).bit_count() * 10_000 + i for i, r in rows if i is not None and r is not None})[:4]
        want += [(q, k + 1, x % 10_000, x // 10_000) for k, x in enumerate(near)]
    assert got == want
    assert len(exact_top_k(df(rows[:2]), df(queries[:1]), 4).collect()) == 2
    assert exact_top_k(df([]), df(queries), 4).count() == 0 and exact_top_k(df(rows), df([]), 4).count() == 0
    v = spark.createDataFrame([([1.0] * 64,), ([-1.0] * 63 + [2.0],), ([1.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(sign_code("v")).collect()] == [-1, -(1 << 63), None, None]


# ---- 6


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan(spark, tmp_path, block):
    from tidemark.llm.separators import token_counts

    files = {"a": [1, 2, 9, 9, 3, 9], "b": [5] * 10, "c": [], "d": [9], "e": [4, 4, 4, 4, 9, 7, 7]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in [*files, "a"]], "file string")
    got = sorted((r["file"][-1], r["place"], r["n_tokens"]) for r in token_counts(df, 9, block=block).collect())
    assert got == [("a", 0, 3), ("a", 1, 1), ("a", 2, 2), ("b", 0, 10), ("d", 0, 1), ("e", 0, 5), ("e", 1, 2)]


def test_flat_files(spark, docs, texts, empty, tmp_path):
    from tidemark.llm.separators import token_counts, write_flat

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    places = write_flat(docs, f"file://{tmp_path}/flat", ranks, public_tokenizers.PATTERN, 50256)
    counts = places.join(token_counts(places, 50256), ["file", "place"])
    assert counts.count() == len(texts)
    assert counts.where("id IN (0, 1)").select("n_tokens").distinct().first()[0] == 1
    assert write_flat(empty, f"file://{tmp_path}/none", ranks, public_tokenizers.PATTERN, 50256).count() == 0


# ---- 7


def test_pieces(spark, docs, texts, empty):
    import sentencepiece

    from tidemark.llm.pieces import encode_and_decode, piece_table

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, table = sentencepiece.SentencePieceProcessor(model_file=path), piece_table(path)
    rnd = random.Random(12)
    odd = [t or "" for t in texts] + ["".join(rnd.choice("abé  \n▁日😀the\x00<s></s>ing") for _ in range(rnd.randrange(60))) for _ in range(1000)]
    for t in odd:
        ids = library.encode(t)
        assert table.encode(t) == ids and table.decode(ids) == library.decode(ids)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in encode_and_decode(docs, path, ids=True).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for t in texts:
        ids = [*library.encode(t or ""), 2]
        want.append((len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), tuple(ids)))
    assert got == sorted(want)
    assert encode_and_decode(empty, path).count() == 0


# ---- 8


def test_shards(spark, docs, texts, empty):
    import heapq

    from tidemark.llm.shards import deal, lpt_shards

    rows = lpt_shards(docs, 3).collect()
    assert len(rows) == len(texts)
    by = Counter(r["shard"] for r in rows)
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    assert len({r["shard"] for r in rows if r["size"] == len("same text here for all of us") + 1}) == 1
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for t in texts)
    assert all(r["text_crc32"] == 0 for r in rows if r["size"] == 1)
    assert lpt_shards(empty, 3).count() == 0
    rnd = random.Random(1)
    for _ in range(40):
        classes = sorted(((s, float(s), rnd.randrange(1, 60)) for s in {rnd.randrange(1, 90) for _ in range(9)}), reverse=True)
        loads, heap = [0.0] * 5, [(0.0, i) for i in range(5)]
        for name, first, last, shard in deal(classes, [0.0] * 5):
            loads[shard] += (last - first) * name
        for s, _, n in classes:
            for _ in range(n):
                load, i = heapq.heappop(heap)
                heapq.heappush(heap, (load + s, i))
        assert sorted(loads) == sorted(x for x, _ in heap)


# ---- 9


def test_token_files(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.tokenfiles import read_tokens, with_crc32, write_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [*texts, "<|startoftext|> it's ÀÉ ΣΣ ½² İ", "\x85\x0b"]
    d = spark.createDataFrame([(len(odd) - i, t) for i, t in enumerate(odd)], "doc_id long, text string").repartition(3)
    out = f"{tmp_path}/t"
    write_tokens(d, f"file://{out}", path, 1, row_group=4096, page=1024)
    at = 0
    for r in sorted(with_crc32(read_tokens(spark, f"file://{out}")).collect(), key=lambda r: r["id"]):
        ids = np.array([*library.encode(odd[len(odd) - r["id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    file = next((tmp_path / "t").glob("part-*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DELTA" in e for e in columns["n_tokens"].encodings)
    assert any("DICTIONARY" in e for c, x in columns.items() if c.startswith("ids") for e in x.encodings)
    assert columns["n_tokens"].has_offset_index
    write_tokens(empty, f"file://{tmp_path}/e", path, 1)
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# ---- 10


@pytest.mark.parametrize("fine", [False, True])
def test_covering_code(fine):
    from tidemark.llm.simhash import CoveringCode, golay_columns, hamming_columns, parts_of

    parts, slack = parts_of(4)
    n = parts[0][1]
    code = CoveringCode(hamming_columns(n) if fine else golay_columns(n), slack)
    assert code.radius == (1 if fine else 3)
    words = np.random.default_rng(2).integers(0, 1 << n, 300)
    row, anchor, home = code.anchors(words)
    assert home.sum() == 300 and (np.bitwise_count(words[row] ^ anchor) <= code.radius + slack).all()
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    for i, x in enumerate(words.tolist()):
        mine = set(anchor[row == i].tolist())
        for b in range(n):
            _, a, h = code.anchors(np.array([x ^ (1 << b)]))
            assert a[h][0] in mine
        assert homes[i] in mine


def plain_components(texts, ids):
    prints = []
    for t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [(ids[i], prints[i], least.get(root(i))) for i in range(len(texts))]


def test_near_duplicates(spark, docs, texts, empty):
    from tidemark.llm.simhash import near_duplicates

    rnd = random.Random(4)
    base = [f"w{rnd.randrange(300)}" for _ in range(400)]
    chain = []
    for k in range(12):  # each close to the one before
        base = base[: 30 * k] + ["new"] + base[30 * k + 1 :]
        chain.append(" ".join(base))
    every = texts + chain
    ids = [r[0] for r in rows_of(every)]
    got = sorted(((r["id"], r["fp"] & (2**64 - 1), r["component"]) for r in near_duplicates(spark.createDataFrame(rows_of(every), DOCS)).collect()), key=str)
    assert got == sorted(plain_components(every, ids), key=str)
    fine = near_duplicates(spark.createDataFrame(rows_of(every), DOCS), fine=True).collect()
    assert sorted(((r["id"], r["fp"] & (2**64 - 1), r["component"]) for r in fine), key=str) == got
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    from tidemark.llm.components import connected_components

    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 700)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(3, 3), (None, 4)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if x is not None and root(x) != x}


# ---- pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    found = {r["doc_id"] for r in rows.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < len(found) < docs.count()
    copies = docs.groupBy("text").agg(F.collect_set("doc_id").alias("ids")).where(F.size("ids") > 1).collect()
    assert all(len(found & set(r["ids"])) <= 1 for r in copies)
