"""Packed sequences against the library's ids, and windows against all multisets."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.packing import Bins, Encoder, fill, in_powers, op13_packing, pack, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_encoder_gives_the_ids_of_the_library():
    with open(PATH, "rb") as f:
        encoder = Encoder(f.read())
    assert encoder.by_word
    whole = library()
    texts = [chr(c) for c in range(0x250)] + [f"a{chr(c)}B {chr(c)}{chr(c)}'S{chr(c)}" for c in range(0x250)]
    texts += ["", " ", "It's we'LL they're I'M !'s ''t", "ΑΣ ΣΑΣ", "İstanbul İ", "é é", "x<|endoftext|>y <|startoftext|>", "a b c\x1cd\x85e", "日本語 12½³ ٣", "w" * 5000, "a\x00b", "ǅ ŉ ſ ﬁ"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcÀéßñÖ0129 \n\t'’.,!-s<|>") for _ in range(rng.randrange(80))) for _ in range(400)]
    for _ in range(2):  # cold and warm
        for t in texts:
            assert numbers(encoder.ids(t)) == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_files_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        encoder = Encoder(f.read())
    assert not encoder.by_word
    assert numbers(encoder.ids("Hello, it's ünusual")) == Tokenizer.from_file(path).encode("Hello, it's ünusual", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_fill_is_the_best_multiset(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
    room = rng.randrange(0, 60)
    used = fill(Counter(items), sorted(set(items)), room)
    assert all(n <= items.count(k) for k, n in used.items())
    best = max(s for n in range(len(items) + 1) for c in combinations(items, n) if (s := sum(c)) <= room)
    assert sum(k * n for k, n in used.items()) == best


@pytest.mark.parametrize("lengths", [[5] * 40, [15] * 33, [1] * 7, [9, 8, 7] * 30, [16, 1], []])
def test_bins_fill_all_windows_but_the_last(lengths):
    bins = Bins(16)
    for i, n in enumerate(lengths):
        bins.add((i, 0, np.arange(n, dtype="<u4").tobytes(), n))
    made = list(bins.windows(0))
    sizes = [sum(len(p[2]) // 4 for p in w) for w in made]
    assert sum(sizes) == sum(lengths) and all(s == 16 for s in sizes[:-1])
    parts = [w for x in made for w in ([x] if sum(len(p[2]) for p in x) == 64 else in_powers(x))]
    assert all((s := sum(len(p[2]) // 4 for p in w)) & (s - 1) == 0 for w in parts)
    seen = sorted((p[0], p[1] + k) for w in parts for p in w for k in range(len(p[2]) // 4))
    assert seen == [(i, k) for i, n in enumerate(lengths) for k in range(n)]


def rows_of(spark):
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "x9", "don't", "...", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 40, 700, 3000)))), "q", 1) for i in range(60)]
    rows += [(100 + i, "same text again", None, None) for i in range(90)] + [(7, "twice", "", 0), (None, None, None, 2), (None, "", None, 3), (200, "<|endoftext|> in it", "", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string, ids int")


@pytest.mark.parametrize("capacity, hold, parts", [(64, 16, 3), (2048, 4096, 1), (100, 2, 5)])
def test_pack(spark, capacity, hold, parts):
    rows, df = rows_of(spark)
    got = pack(df.repartition(parts), PATH, capacity, hold=hold).collect()
    whole = library()
    want = Counter()
    for i, text, *_ in rows:
        want[(i, tuple([*whole.encode(text or "", add_special_tokens=False).ids, 1]))] += 1
    by_seq = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_seq.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    single = Counter(i for i, *_ in rows)
    for (i, ids), n in want.items():
        if single[i] == n == 1:
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
            assert tuple(numbers(b"".join(r.ids for r in own))) == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())


def test_sequences(spark):
    _, df = rows_of(spark)
    pieces = pack(df, PATH, 64).cache()
    told = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)):
        told[r.sequence_id] = told.get(r.sequence_id, b"") + bytes(r.ids)
    assert {r.sequence_id: bytes(r.ids) for r in sequences(pieces).collect()} == told
    assert pack(df.limit(0), PATH).count() == 0


def test_query(spark, tmp_path):
    import zlib

    _, df = rows_of(spark)
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_packing(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = np.array([*library().encode("<|endoftext|> in it", add_special_tokens=False).ids, 1], "<u4").tobytes()
    own = got.filter(F.col("doc_id") == 200).collect()
    assert sum(r.length for r in own) == len(ids) // 4
    if len(own) == 1:
        assert own[0].ids_crc32 == zlib.crc32(ids)
