"""The trie against a dictionary of all prefixes, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm.trie import OP11_SQL, branched, op11_trie, prefix_trie, trie_nodes, turn_sequences

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(sequences):
    """Nodes of sequences {id: [(turn, words)]} from all prefixes."""
    at, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for i, s in sequences.items():
        for d in range(len(s) + 1):
            key = tuple(t for t, _ in s[:d])
            at[key].append(i)
            if d:
                words[key] = s[d - 1][1]
        ends[tuple(t for t, _ in s)].append(i)
    kids = defaultdict(set)
    for key in at:
        if key:
            kids[key[:-1]].add(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, ids in at.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(ids) - 1) * words[key]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(ids), len(k), min(at[k[:-1]]) if k else -1, len(ids), len(kids[k]), leaves[k], saved[k], sha(ends[k])) for k, ids in at.items())


def found(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(COLUMNS).collect())


def made(seed, hot, n=150):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        if i % 3 == 0:
            out[i * 7] = [(("u", "hot"), 1)] * hot + [(("a", f"x{i % 2}"), 1)] * (i % 4)  # a third share much
        else:
            out[i * 7] = [(t := rng.choice("abc"), ord(t) % 5) for _ in range(rng.randrange(6))]
    out[5000] = [("c", ord("c") % 5)] * 60
    return out


def frame(spark, sequences):
    rows = [(i, p, repr(t).encode(), w) for i, s in sequences.items() for p, (t, w) in enumerate(s, 1)] + [(i, None, None, None) for i, s in sequences.items() if not s]
    return spark.createDataFrame(rows, "id long, pos long, digest binary, words long")


@pytest.mark.parametrize("local, digits, hot", [(1 << 16, 8, 12), (4, 1, 2), (10, 3, 7)])
def test_trie(spark, local, digits, hot):
    sequences = made(local, hot)
    assert found(prefix_trie(frame(spark, sequences), local, digits)) == plain(sequences)


def test_edges(spark):
    for sequences in ({3: []}, {3: [], 1: []}, {1: [("a", 2)], 2: [("a", 2)]}, {9: [("a", 2), ("b", 0)]}):
        assert found(prefix_trie(frame(spark, sequences))) == plain(sequences)
        assert found(prefix_trie(frame(spark, sequences), 0, 1)) == plain(sequences)
    assert prefix_trie(frame(spark, {})).count() == 0


def test_quicksort_of_one_bucket():
    rng = random.Random(1)
    members = [(i, [7] + [rng.randrange(3) for _ in range(rng.randrange(9))]) for i in range(200)]
    nodes = trie_nodes([(i, c, [x + 1 for x in c]) for i, c in members], 0, 0)
    whole = plain({i: [(x, x + 1) for x in c] for i, c in members})
    assert sorted(tuple(n[:8]) for n in nodes) == [n for n in whole if n[1]]
    deep = trie_nodes([(i, [1] * 5000, [1] * 5000) for i in range(3)], 0, 0)
    assert len(deep) == 5000 and deep[0][6] == 10000


def conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 70), 200, 233, 1007]:
        if c == 40:  # a base that is absent
            continue
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("one two", "three", None, "", " a\tb  c ")), 1))
    rows += [(20, None, "system", "first", 0), (21, 3, "user", "tie b", 0), (21, 3, "user", "tie a", 0), (22, 0, "user", "again", 0), (22, 0, "user", "again", 0), (None, 1, "user", "lost", 0)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id int")


def test_query(spark, tmp_path):
    rows, df = conversations(spark)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [((r, x), len(x.split())) for *_, r, x in sorted(v)] for c, v in by.items()}
    want = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + s[h:]
    got = op11_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert found(got) == plain(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    told = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in told) == plain(want)


def test_clashing_names(spark):
    _, df = conversations(spark)
    odd = df.select("conv_id", "turn", "role", "text", F.lit(1).alias("pos"), F.lit("x").alias("digest"), F.lit(2).alias("rank"))
    assert sorted(turn_sequences(odd).collect()) == sorted(turn_sequences(df).collect())
    assert branched(turn_sequences(df.limit(0))).count() == 0
