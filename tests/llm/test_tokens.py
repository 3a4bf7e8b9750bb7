"""Counts of every prefix against the tokenizers library."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm.tokens import PrefixCounter, token_counts, tokens_at

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the ", " ", "  ", "\n", "\t", "\r\n", "'re", "'ve", "'s", "'l", "'ll", "l", "I'", "<|endoftext|>", "<|end", "é", "世界", "😀", "　", "\xa0", "123", "!!", "...", "ing", "\x1c", "\x85", "'"]


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return PrefixCounter(f.read(), pieces=200), Tokenizer.from_file(PATH)


def same(both, text):
    counter, library = both
    prefixes = [text[:i] for i in range(len(text) + 1)]
    want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
    assert counter.counts(text).tolist() == want, repr(text)


def test_prefixes_of_awkward_texts(both):
    rng = random.Random(1)
    for _ in range(400):
        same(both, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=24))
def test_prefixes_of_any_text(both, text):
    same(both, text)


def test_operator(spark, both):
    long = "word " * 5000 + "x" * 3000
    rows = [(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (4, long, 9), (5, "<|endoftext|>" * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_count int")
    out = token_counts(docs, PATH, limit=100, table=True)
    assert out.columns == ["doc_id", "text", "token_count", "cut_chars", "token_steps"]
    for r in out.collect():
        text = r.text or ""
        ids = both[1].encode(text, add_special_tokens=False).ids
        assert r.token_count == len(ids)
        at = lambda n: len(both[1].encode(text[:n], add_special_tokens=False).ids)
        assert at(r.cut_chars) <= 100
        assert r.cut_chars == len(text) or at(r.cut_chars + 1) > 100
    asked = out.withColumn("n", (out.cut_chars / 2).cast("int"))
    for r in asked.withColumn("k", tokens_at(asked.token_steps, asked.n)).collect():
        assert r.k == len(both[1].encode((r.text or "")[: r.n], add_special_tokens=False).ids)
    assert token_counts(docs.limit(0), PATH).count() == 0
