"""Removal of repeated passages against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from riskloom.llm.suffixes import gram_lengths, previous_factors, previous_smaller, remove_repeats, repeats, suffix_order


def brute(rows, length, keep):
    seen = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((k, p))
    cover = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        for j, (k, p) in enumerate(sorted(places)):
            if len(places) > 1 and (keep == "none" or j):
                cover[k][p : p + length] = b"\1" * length
    out = []
    for (i, t), c in zip(rows, cover, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        spans = sum(1 for q in range(len(c)) if c[q] and (q == 0 or not c[q - 1]))
        out.append((i, sum(c), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    part = lambda: rng.choice(base)[rng.randint(0, 20) : rng.randint(60, 200)] if rng.random() < 0.5 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
    rows = [(i, "".join(part() for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "a" * 45), (n + 4, "q" * 50), (n + 5, "q" * 40), (n + 6, base[0] * 3), (n + 7, base[0] * 3)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group", [8192, 3])
def test_against_all_windows(spark, keep, group):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, t int, id string")
    out = remove_repeats(docs, 40, keep, group)
    assert out.columns == ["doc_id", "text", "t", "id", "_removed"]
    got = sorted((r.doc_id, r._removed.n_removed, r._removed.n_spans, r._removed.kept_sha256, bytes(r._removed.kept)) for r in out.collect())
    assert got == brute(rows, 40, keep)


def test_texts_of_many_parts(spark):
    rng = random.Random(1)
    shared = "".join(chr(rng.randint(97, 122)) for _ in range(700_000))
    rows = [(1, "x" + shared), (2, shared[100_000:650_000] + "y"), (3, "z" * 1_200_000)]
    got = {r.doc_id: r._removed.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, "none", with_bytes=False).collect()}
    assert got == {1: 550_000, 2: 550_000, 3: 1_200_000}


def test_repeated_rows_null_ids_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(90))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "!"), (2, "short")], "doc_id long, text string")
    got = {(r.doc_id, r._removed.n_removed) for r in remove_repeats(docs, 40, "none").collect()}
    assert got == {(1, 90), (None, 90), (2, 0)}
    assert remove_repeats(docs.limit(0), 40).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    for depth in (3, 8, 20, 64):
        order, _ = suffix_order(text, depth)
        raw = text.tobytes() + b"\0" * 0
        assert order.tolist() == sorted(range(400), key=lambda i: (raw[i : i + depth], i))
    earlier, other = repeats([b"abcdefgh" * 3, b"abcdefghabcdefgh"], 16)
    assert earlier[0].tolist()[:9] == [False] * 8 + [True] and other[1][0]


def naive_factors(text, starts, depth):
    out = []
    for i in starts:
        best = 0
        for j in (j for j in starts if j < i):
            k = 0
            while k < depth and i + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("depth", [1, 5, 8, 13, 40, 64])
def test_longest_previous_factors(depth):
    rng = np.random.default_rng(depth)
    texts = [rng.integers(97, 97 + k, 180).astype(np.uint8) for k in (1, 2, 4)]
    texts += [np.concatenate((t[40:120], t, t[::-1], t[:90])) for t in texts] + [np.tile(texts[2][:23], 9), np.frombuffer(b"ab\0\0c\0ab\0\0c\0ab", np.uint8)]
    for text in texts:
        for starts in (np.arange(len(text)), np.flatnonzero(rng.random(len(text)) < 0.5)):
            lengths, sources = previous_factors(text, starts, depth)
            assert lengths.tolist() == naive_factors(text, starts.tolist(), depth)
            for i, n, j in zip(starts.tolist(), lengths.tolist(), sources.tolist(), strict=True):
                assert (n == 0 and j == -1) or (j < i and (text[i : i + n] == text[j : j + n]).all())


def test_previous_smaller():
    rng = np.random.default_rng(2)
    for x in (rng.permutation(3000), np.arange(3000), np.arange(3000)[::-1], np.concatenate((np.arange(1, 5000), [0], np.arange(9000, 5000, -1), [1]))):
        stack, want = [], []
        for i, v in enumerate(x.tolist()):
            while stack and x[stack[-1]] >= v:
                stack.pop()
            want.append(stack[-1] if stack else -1)
            stack.append(i)
        assert previous_smaller(x).tolist() == want


def test_gram_lengths():
    assert gram_lengths(400) == [32, 309, 378, 396, 400] and gram_lengths(32) == [32]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchor_stays_in_suffix_order(spark, keep):
    """One passage in every text, shorter than a window, between texts that are each text's own or shared by two."""
    rng = random.Random(7)
    own = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, sides = own(55), [own(20) for _ in range(25)]
    rows = [(i, rng.choice(sides) + passage + rng.choice(sides) + own(5)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (1, 10, 2048):
        got = sorted((r.doc_id, r._removed.n_removed, r._removed.n_spans, r._removed.kept_sha256, bytes(r._removed.kept)) for r in remove_repeats(docs, 60, keep, group).collect())
        assert got == brute(rows, 60, keep)
