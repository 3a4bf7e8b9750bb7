"""Search against SQLite's own full-text index, which stems, folds and ranks the same way."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from riskloom.operators.fulltext import parse, search, terms, text_index, top_texts, with_stem

WORDS = "relate related relational conditional rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky yes yoyo syzygy toy enjoyment being skies dying lying news proceed geology apology bliss ably nobly is as a ion lion ionization eye owe free freed fee agree tree oxen maximum archaeology possibly generalizations oscillators".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    syllables = "re con form al iz ation er ing ed y ly ness ful ous ive at bl ti sion e s ee ll ss tt".split()
    made = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    made = [w for w in made if "yy" not in w]  # SQLite takes y and consonants in turns there
    return sorted(set(WORDS + made + ["Éclair", "naïveté", "Straße", "x_y", "don't", "日本", "w" * 70]))


def test_stems(spark, corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", list(enumerate(corpus)))
    want = {}
    for term, doc, _, offset in con.execute("SELECT * FROM v"):
        want[(doc, offset)] = term
    df = spark.createDataFrame(list(enumerate(corpus)), "id int, a string")
    got = {(r.id, r.pos): r.s for r in with_stem(df.select("id", F.posexplode(terms(F.col("a"))).alias("pos", "w")), "w", "s").collect()}
    wrong = {corpus[k[0]]: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    wrong.pop("eed", None)  # too short for SQLite's rule
    assert not wrong, wrong


QUERIES = [
    "login", "logins", "LOGIN user", '"user login"', '"user login" OR token', "user NOT login", "user AND (login OR token)", "log*", '"user log"*', "name: login", "{name file}: login", "kind: (login OR user)", "user + login", "user OR token NOT login",
    "user token login", "a OR b AND c", "user AND", "(user", '"open', "user-login", "", "AND", "name:", "nowhere", "unknown: login", '""', "x_y", "NOT user", "user NOT login NOT token", "user OR login AND token", "Étoile", "user.login",
]


def test_queries(spark):
    rng = random.Random(4)
    vocabulary = ["user", "users", "login", "logins", "token", "logging", "a", "b", "c", "étoile", "x", "y"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(7))), rng.choice(("login", "function", "")), "src/" + rng.choice(vocabulary) + ".ts") for i in range(300)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, kind, file, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, name, kind, file) VALUES (?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, name string, kind string, file string")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string")
    found = search(text_index(df, "id", "name", "kind", "file").cache(), asked).cache()
    got = {}
    for r in found.collect():
        got.setdefault(r.query, {})[r.id] = r.score
    for q, text in enumerate(QUERIES):
        try:
            want = {i: -s for i, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (text,))}
        except sqlite3.OperationalError:
            want = {}
        own = got.get(q, {})
        assert own.keys() == want.keys(), text
        if "NOT" not in text and "OR" not in text and ":" not in text:
            assert all(abs(own[i] - s) < 1e-6 * max(1, abs(s)) for i, s in want.items()), text
    best = top_texts(found.filter("query = 0"), 3).orderBy("rank").collect()
    assert [r.rank for r in best] == [0, 1, 2] and best[0].score >= best[2].score


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "id int, a string")
    asked = spark.createDataFrame([("q", "one"), ("r", None), ("s", "two")], "query string, text string")
    assert [(r.query, r.id) for r in search(text_index(df, "id", "a"), asked).collect()] == [("q", 3)]
    assert search(text_index(df.limit(0), "id", "a"), asked).count() == 0
    assert parse("a b OR c")[1] == ["0", "1", "AND", "2", "OR"]
