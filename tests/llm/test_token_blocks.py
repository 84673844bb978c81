"""Blocks of texts against the tokenizer itself, one text after the other."""

import random

import pyarrow as pa
import pytest

from tidemark.llm.tokenfiles import BlockEncoder, _blocks

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = [*"ab 's't're ST É ñ.,!?<|>\n\t\r\x0b\x0c\x1c\x1f\x85\xa0’œİ²½9日ªßµ́ſ", "<|endoftext|>", "'ll ", "don't", " the ", " Réel. "]


@pytest.fixture(scope="module")
def encoder():
    return BlockEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_blocks_have_the_tokenizers_ids(encoder):
    pick = random.Random(5)
    texts = [None, "", " ", *("".join(pick.choices(PARTS, k=pick.randint(0, 40))) for _ in range(4000)), "a" * 5000, "é." * 4000]
    flat, n = encoder.encode(pa.array(texts).slice(1), 1)
    at = 0
    for text, k in zip(texts[1:], n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], repr(text)
        at += k
    assert at == len(flat)


def test_blocks_are_whole_rows():
    rows = pa.RecordBatch.from_pydict({"id": range(6), "text": ["x" * 10, None, "y" * 500, "", "z" * 90, "w"]})
    found = list(_blocks(rows, 1, 100))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(6))
    assert all(b.num_rows for b in found)
    assert not list(_blocks(rows.slice(0, 0), 1, 100))
