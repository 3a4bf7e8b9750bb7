"""Near-duplicate components against all pairs, with groups of copies and edits."""

import random

import numpy as np
import pytest

from riskloom.llm.components import connected_components
from riskloom.llm import neardup
from riskloom.llm.neardup import HASHES, first_of_each, least_matches, near_duplicates, shingle_sets, signatures


def brute(rows, n, percent=80):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [rng.choice(["zz", "qq", w + "x", "Y" + w]) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("n", [4, 5])
def test_components(spark, n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randint(0, 3000)}"
    base = [[word() for _ in range(rng.randint(30, 300))] for _ in range(12)]
    texts = [" ".join(edited(rng, rng.choice(base), rng.choice([0, 0.005, 0.02, 0.04]))) for _ in range(120)]
    # a third of all are copies of one text at the edge of similarity: neither all linked nor all apart
    hot = [word() for _ in range(200)]
    texts += [" ".join(edited(rng, hot, 0.012)) for _ in range(90)] + [" ".join(hot)] * 20
    texts += ["", " \t\n", "One two", "one  TWO", "one", "a b c d e", "É b c d e", "é b c d e", "long " * 20000, None]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, id int, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, n=n).collect()}
    assert got == brute(rows, n)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, text), (3, text + " tail"), (3, text + " tail"), (None, "alone here"), (9, "other words only")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in near_duplicates(docs, n=5).select("doc_id", "component_id").collect())))
    assert got == sorted(map(str, [(None, 3), (None, 3), (3, 3), (3, 3), (None, None), (9, 9)]))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    a = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(3000)).encode()
    words = a.split()
    b = b" ".join(words[:2400] + [w + b"x" for w in words[2400:]])
    s = shingle_sets([a, b, b""], 5)
    true = len(np.intersect1d(s[0], s[1])) / len(np.union1d(s[0], s[1]))
    sig = signatures(s)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (0.25 / HASHES) ** 0.5
    assert not sig[2].any()
    assert least_matches(80, 1e-6) == sorted(least_matches(80, 1e-6))


def test_connected_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    alone = {x for p in pairs if p[0] == p[1] for x in p} - {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in root if x not in alone}


def test_ids_with_several_texts(spark):
    """Each text of an id is linked by itself, in whatever order the rows come."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    changed = b.replace("b100 ", "q ")
    for rows in ([(5, a), (5, b), (9, changed)], [(9, changed), (5, b), (5, a)]):
        got = {(r.doc_id, r.n_shingles, r.component_id, r.component) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {(i, m) for i, _, m, _ in got} == {(5, 5), (9, 5)} and len(got) == 3
        assert len({k for _, _, _, k in got}) == 2
    docs = spark.createDataFrame([(1, a, 0), (2, a, 0), (2, c, 3), (2, c, 1), (None, "only one", 0), (None, "", 4), (None, "", 2), (7, None, 0)], "doc_id long, text string, _h int")
    left = sorted(map(repr, map(tuple, first_of_each(docs).collect())))
    assert left == sorted(map(repr, [(1, a, 0), (2, c, 1), (None, "only one", 0), (None, "", 2), (7, None, 0)]))


def test_blocks_of_a_large_group(spark):
    """Variants of one text that are near, but mostly not near enough: every block of strays meets every block of members."""
    rng = random.Random(3)
    hot = [f"h{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, hot, 0.03))) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5)
    assert 5 < len({c for _, c in want.values()}) < 255
    real = neardup._Search.finish
    try:
        for few, many, most_bytes in ((256, 512, 4 << 20), (8, 16, 4 << 20), (256, 512, 6000)):
            neardup._Search.finish = lambda self, a=few, b=many, c=most_bytes: real(self, a, b, most_bytes=c)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == want
    finally:
        neardup._Search.finish = real
