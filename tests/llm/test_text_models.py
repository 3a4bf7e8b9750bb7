"""Decontamination, licences and quality on small corpora."""

import random
import re

from riskloom.llm.decontaminate import contaminated, smith_waterman, without_benchmark
from riskloom.llm.licenses import LICENCES, PHRASES, TEMPLATES, Automaton, scan_licenses
from riskloom.llm.quality import Scorer, expectation_maximisation, fit, score_quality

import numpy as np
from pyspark.sql import functions as F


def align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_smith_waterman():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 4, rng.integers(1, 20)) for _ in range(60)]
    b = [rng.integers(0, 4, rng.integers(1, 40)) for _ in range(60)]
    assert smith_waterman(a, b).tolist() == [align(x, y) for x, y in zip(a, b, strict=True)]


def test_contaminated(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(14, 60)))) for i in range(50)]
    docs = []
    for i, t in items:
        w = t.split()
        for j in rng.sample(range(len(w)), max(1, len(w) // 9)):
            w[j] = rng.choice(["zz", w[j] + "x"])
        if len(w) > 20:
            del w[7]
        docs.append((i, " ".join(f"n{rng.randint(0, 99)}" for _ in range(200)) + " " + " ".join(w).upper() + " tail" * 5))
    docs += [(1000 + i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(600))) for i in range(200)]
    docs += [(5000, None), (5001, ""), (None, items[0][1]), (None, "clean words"), (6000, "n1 " * 60000)]
    docs += [(7000 + i, "a b " + items[1][1]) for i in range(150)]  # one item in a third of all texts
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    for block in (4 << 20, 500):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, bench, block_bytes=block).collect()}
        assert got == {(i, i) for i, _ in items} | {(7000 + i, 1) for i in range(150)} | {(None, 0)}
    left = without_benchmark(df, bench)
    assert left.columns == df.columns
    assert left.count() == len(docs) - 201
    assert without_benchmark(df, bench.limit(0)).count() == len(docs)
    assert contaminated(df.limit(0), bench).count() == 0


def test_contaminated_without_long_seeds(spark):
    """Copies that share no three words in a row, or only one such run, and an exact copy of three words."""
    words = [f"w{i}" for i in range(15)]
    changed = [f"z{i}" if i in (2, 5, 8, 11) else w for i, w in enumerate(words)]
    gapped = [x for i, w in enumerate(words) for x in ([w, f"y{i}"] if i % 2 else [w])]
    docs = [(1, changed), (2, gapped), (3, ["three", "short", "words"]), (4, words[:8]), (5, ["three", "other", "words"])]
    df = spark.createDataFrame([(i, " ".join(["before"] * 30 + w + ["after"] * 30)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "three short words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in contaminated(df, bench).collect()}
    assert got == {(i, k): s for i, w in docs for k, t in ((1, words), (2, ["three", "short", "words"])) if (s := round(align(t, w) / (2 * len(t)), 6)) >= 0.6}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}


def test_contaminated_against_all_alignments(spark):
    """Every document with every item of 1 to 60 words, by plain alignment of the whole text."""
    rng = random.Random(9)
    word = lambda n: f"w{rng.randint(0, n)}"
    items = [(n, [word(400) for _ in range(n)]) for n in [*range(1, 13), 15, 20, 30, 45, 60]]
    items += [(100, ["again"] * 8), (101, ["a", "b"] * 6), (102, ["only", "one", "only", "two"])]
    docs = []
    for k, (_, w) in enumerate(items):
        for edit in range(7):
            own = list(w)
            for _ in range(round(len(w) * edit / 18)):
                j = rng.randrange(len(own))
                own[j : j + rng.choice([0, 1])] = [rng.choice(["zz", word(400)])] * rng.choice([0, 1])
                own = own or ["zz"]
            if edit == 5:
                own = [x for v in w for x in (v, "yy")]
            if edit == 6:
                own = [x for j, v in enumerate(w) for x in ([v, "yy"] if j % 2 else [v])]
            docs.append((k * 10 + edit, [word(900) for _ in range(rng.randint(0, 40))] + own + [word(900) for _ in range(rng.randint(0, 40))]))
    docs += [(5000 + i, [word(60) for _ in range(150)]) for i in range(20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    scores = {(i, k): align(t, w) / (2 * len(t)) for i, w in docs for k, t in items if set(t) & set(w)}
    for least in (1, 3):
        for threshold in (0.6, 0.8):
            got = {(r.doc_id, r.item_id): round(r.score, 9) for r in contaminated(df, bench, threshold, least=least).collect()}
            assert got == {p: round(v, 9) for p, v in scores.items() if v >= threshold - 1e-12 and len(dict(items)[p[1]]) >= least}
    clash = df.withColumns({c: F.lit("x") for c in ("_hit_id", "_hit_hash", "item_id", "score")})
    left = without_benchmark(clash, bench)
    assert left.columns == clash.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for (i, k), v in scores.items() if v >= 0.6 - 1e-12 and len(dict(items)[k]) >= 3}


def test_automaton_finds_longest_matches():
    rng = random.Random(5)
    strings = [[rng.randint(0, 3) for _ in range(rng.randint(4, 20))] for _ in range(5)]
    strings += [strings[0][:6], strings[1][2:9], strings[0] + strings[1]]
    automaton = Automaton.of(strings)
    held = [{tuple(s[i:j]): [e for e in range(1, len(s) + 1) if s[e - (j - i) : e] == s[i:j] and e >= j - i] for i in range(len(s)) for j in range(i + 1, len(s) + 1)} for s in strings]
    for _ in range(50):
        text = [rng.randint(0, 4) for _ in range(30)]
        longest = lambda k, end: max((n for n in range(1, end + 1) if tuple(text[end - n : end]) in held[k]), default=0)
        want = []
        for k in range(len(strings)):
            reach = [longest(k, end) for end in range(len(text) + 1)] + [0]
            want += [(end, reach[end], k, held[k][tuple(text[end - reach[end] : end])]) for end in range(len(text) + 1) if reach[end] >= 3 and reach[end + 1] != reach[end] + 1]
        assert sorted((*m[:3], sorted(m[3])) for m in automaton.matches(text, 3)) == sorted(want)


def test_licences(spark):
    rng = random.Random(2)
    pieces = [*PHRASES, *TEMPLATES.values(), "CC-BY 4.0", "mit\x00license", "é", "gnu general", "public license", "x", "MIT MIT License", "the the"]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "mit license " * 20000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    rows = {r.doc_id: r.license for r in scan_licenses(df).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((k for k, _ in places), default=None) and r.last_word == max((k for k, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    for label, text in TEMPLATES.items():
        r = scan_licenses(spark.createDataFrame([(1, "before " + text + " after")], "doc_id long, text string")).first().license
        assert label in r.labels.split(",") and r.score == 1 and any(s.template == label and s.start_word == 1 for s in r.spans)


def test_licence_with_a_doubled_word(spark):
    """The match after a doubled word begins a word early; the chain goes on and counts each template word once."""
    long = {k: t.split() for k, t in TEMPLATES.items() if k.endswith("-notice")}
    docs = [(k, " ".join(w[: len(w) // 2] + w[len(w) // 2 - 1 :])) for k, w in long.items()]
    docs += [(f"{k} twice", " ".join(w + w)) for k, w in long.items()]
    for r in scan_licenses(spark.createDataFrame(docs, "doc_id string, text string")).collect():
        label = r.doc_id.split()[0]
        spans = [s.coverage for s in r.license.spans if s.template == label]
        assert label in r.license.labels.split(",") and r.license.score == 1
        assert spans == [1.0] * (2 if r.doc_id.endswith("twice") else 1)


def test_whole_licences(spark):
    """A file with a whole licence gets its label; one that only quotes a part of it does not."""
    docs = [(k, "Copyright 2020 someone\n" + t) for k, t in LICENCES.items()] + [(f"part of {k}", " ".join(t.split()[: len(t.split()) // 3])) for k, t in LICENCES.items()]
    for r in scan_licenses(spark.createDataFrame(docs, "doc_id string, text string")).collect():
        found = {s.template: s for s in r.license.spans}
        label = r.doc_id.removeprefix("part of ")
        if label == r.doc_id:
            assert r.license.score == 1 and found[label].coverage == 1 and found[label].start_word == 3
        else:
            assert label not in found


def test_chained_spans_against_segments(spark):
    """Edits cut a template into segments; those of `least` words or more are covered, in one span."""
    rng = random.Random(4)
    templates = {f"t{k}": [f"w{k}x{i}" for i in range(n)] for k, n in enumerate((9, 30, 80, 200))}
    docs, want = [], {}
    for i in range(120):
        text, spans = [f"f{j}" for j in range(rng.randint(0, 9))], []
        for name in rng.sample(sorted(templates), 2):
            words, segments, run = templates[name], [], 0
            start = len(text)
            for w in words:
                edit = rng.random()
                if edit < 0.02:  # dropped
                    segments.append((start, run))
                    start, run = len(text), 0
                    continue
                if edit < 0.05:  # replaced, or one put before
                    segments.append((start, run))
                    text.append("zz")
                    start, run = len(text), 0
                    if edit < 0.035:
                        continue
                text.append(w)
                run += 1
            segments.append((start, run))
            long = [(a, n) for a, n in segments if n >= 4]
            share = sum(n for _, n in long) / len(words)
            if share >= 0.6:
                spans.append((name, long[0][0], sum(long[-1]), round(share, 9)))
            text += [f"g{j}" for j in range(250)]
        docs.append((i, " ".join(text)))
        want[i] = sorted(spans)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = scan_licenses(df, {k: " ".join(w) for k, w in templates.items()}).collect()
    assert {r.doc_id: sorted((s.template, s.start_word, s.end_word, round(s.coverage, 9)) for s in r.license.spans) for r in rows} == want
    assert all(r.license.labels == ",".join(sorted({s.template for s in r.license.spans})) for r in rows)


def small_corpus(n=400):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        kind = rng.choice(["good"] * 6 + ["caps", "symbols", "again", "abuse", "abuse_b"])
        if kind == "caps":
            words = [w.upper() for w in words]
        elif kind == "symbols":
            words = [w + "%%%" for w in words]
        elif kind == "again":
            words = [w for w in words[:6] for _ in range(20)]
        elif kind.startswith("abuse"):
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"] if kind == "abuse" else ["zorgle", "brakk", "vlix"])
        docs.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind in ("good", "abuse", "abuse_b")), int(kind.startswith("abuse"))))
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = small_corpus()
    docs += [(900, None, "good"), (901, "", "good"), (None, "ba ke lo " * 9, "good"), (902, "ba lo mi tu ke " * 9000, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = score_quality(df, known, name="_q").collect()
    assert len(rows) == len(docs)
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id < 900]
    good = [r._q.kept for r in unseen if r.quality == "good"]
    bad = [r._q.kept for r in unseen if r.quality != "good"]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)
    assert score_quality(df.limit(0), known).count() == 0
    assert score_quality(df, known.limit(0)).count() == len(docs)


def test_null_labels_repeats_and_bounds(spark):
    docs, labels = small_corpus(200)
    docs += [(7, f"text {i} of one id ba ke lo", "good") for i in range(100)] + [(3, docs[3][1], "good")] * 100
    df = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every = fit(df, known)
    assert len(every.digests) == len({t for i, t, _ in docs if i % 2})  # equal texts once
    some = fit(df, known, sample=60)
    assert 10 < len(some.digests) < 110 and set(some.digests.tolist()) <= set(every.digests.tolist())
    assert 0 < len(fit(df, known, sample_features=2000).digests) <= 2000 / 5
    assert len(fit(df, known, sample_features=0).digests) == 0


def test_scorers_learn_what_the_label_model_believes(spark):
    """Same labelled texts, same labels: only unlabelled texts, and so the labellers' accuracy, differ."""
    docs, labels = small_corpus(600)
    rng = random.Random(5)
    pool = lambda: " ".join(rng.choice(["ba", "ke", "lo", "mi", "tu"]) + rng.choice("abcde") for _ in range(60))
    docs += [(2000 + i, f"{pool()} clown", "unclear") for i in range(60)]
    labels += [(2000 + i, 1, i % 2) for i in range(60)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frames = [spark.createDataFrame([d[:2] for d in docs] + [(3000 + i, f"{pool()} zorgle brakk vlix {extra}") for i in range(400)], "doc_id long, text string") for extra in ("idiot", "")]
    sure, unsure = (fit(f, known) for f in frames)
    assert sure.digests.tolist() == unsure.digests.tolist()
    for k in range(3):  # mined words without an insult: the insults miss more of the abuse
        assert unsure.labellers["abuse"][k].flags[1, 0] < sure.labellers["abuse"][k].flags[1, 0] - 0.2
    assert np.abs(sure.posteriors["abuse"] - unsure.posteriors["abuse"]).max() > 0.02
    shared = np.intersect1d(sure.abuse.chosen, unsure.abuse.chosen)
    pick = lambda m: m.abuse.weights[np.searchsorted(m.abuse.chosen, shared)]
    assert np.abs(pick(sure) - pick(unsure)).max() > 0.1


def test_posteriors_do_not_see_their_own_label(spark):
    docs, labels = small_corpus(240)
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    digest = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    models = []
    for flipped in (None, 5, 101):
        rows = [(i, 1 - q if i == flipped else q, 1 - t if i == flipped else t) for i, q, t in labels]
        models.append((flipped, fit(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))))
    base = models[0][1]
    for flipped, other in models[1:]:
        at = base.digests.tolist().index(digest[flipped])
        for kind in ("junk", "abuse"):
            change = np.abs(base.posteriors[kind] - other.posteriors[kind])
            assert change[at] < 1e-12 < change.max()  # others do change


def test_expectation_maximisation_recovers_labellers():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.2
    hit = np.array([0.8, 0.6, 0.7])
    votes = np.where(rng.random((20000, 3)) < np.where(truth[:, None], hit, 0.03), 1, 2)
    votes[rng.random((20000, 3)) < 0.1] = 0
    known = np.where(rng.random(20000) < 0.2, truth.astype(int), 2)
    for gold in (known, np.full(20000, 2)):
        rows, counts = np.unique(np.column_stack((votes, gold)), axis=0, return_counts=True)
        model = expectation_maximisation(rows[:, :3], counts, rows[:, 3])
        assert np.abs(model.flags[1] - hit).max() < 0.05 and np.abs(model.flags[0] - 0.03).max() < 0.02
        assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_accuracy_of_a_labeller_changes_weights():
    rng = np.random.default_rng(6)
    truth = rng.random(3000) < 0.3
    words = [np.array([int(t), 2 + int(rng.integers(0, 40))], np.int32) for t in truth]
    weights = []
    for hit, wrong in ((0.9, 0.05), (0.3, 0.25)):
        votes = np.where(rng.random((3000, 3)) < np.where(truth[:, None], [hit, 0.7, 0.7], [wrong, 0.05, 0.05]), 1, 2)
        rows, counts = np.unique(votes, axis=0, return_counts=True)
        model = expectation_maximisation(rows, counts, np.full(len(rows), 2))
        scorer = Scorer.fit(words, model.posterior(votes))
        weights.append(dict(zip(scorer.chosen.tolist(), scorer.weights, strict=True)))
    assert weights[0][1] > weights[1][1] + 0.2 > 0
