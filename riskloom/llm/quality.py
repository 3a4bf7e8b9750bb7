"""Quality classifier: a weak-label model trains a hashed linear scorer.

Two things make a document bad: junk and abuse. For each, heuristic labellers
flag or pass every document. Expectation-maximisation over the counts of vote
patterns of the whole corpus estimates how often each labeller flags bad and
good documents; the posterior of a pattern is a document's label. A linear
scorer on hashed binary features learns the posteriors of a bounded sample and
scores every document. No posterior contains its document's own known label:
see fit().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.scratch import drop, materialise
from riskloom.llm.words import ALNUM, batches, hash_of, lower, mix, range_hashes, word_ranges

#: Bins of hashed words; bins of the shape features follow them.
BINS = 1 << 22
#: Common English insults.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "vile", "worthless")
#: For each shape of a text the share from which it votes bad; below it, it does not vote.
SHAPES = {
    "symbols": 0.02,
    "bars": 0.03,
    "capitals": 0.25,
    "top_word": 0.2,
    "lines_again": 0.4,
    "few_words": 0.5,
}
#: Steps of the shape features.
STEPS = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7])
#: Bytes of a stem. One that begins two different longer words of a text is a feature beside its words: languages inflect and compound.
STEM = 6
#: Then: an insult, a mined word, two mined words.
MARKS = BINS + len(SHAPES) * len(STEPS)
#: Parts of the known labels; each mines words of its own.
FOLDS = 3
#: Votes of a labeller.
NOT_ASKED, FLAGS, PASSES = 0, 1, 2
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"%&*$#@^~+=<>{}[]\\", np.uint8))
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LETTER = _UPPER | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))
_INSULT_CODES = np.sort(np.array([hash_of(w.encode(), ALNUM) for w in INSULTS], np.uint64))


def describe(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(shapes, bins, insults) of texts: a row of shares, sorted distinct bins of words and shared stems, and how many insults each."""
    folded, first, starts, ends = word_ranges([lower(t) for t in texts], ALNUM)
    hashes = range_hashes(folded, starts, ends)
    longer = np.flatnonzero(ends - starts > STEM)
    stems = range_hashes(folded, starts[longer], starts[longer] + STEM)
    first_longer = np.searchsorted(longer, first)
    shapes, bins = np.zeros((len(texts), len(SHAPES))), []
    known = np.isin(hashes, _INSULT_CODES)
    insults = np.diff(np.concatenate(([0], np.cumsum(known)))[first])
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        own = hashes[first[i] : first[i + 1]]
        words, counts = np.unique(own, return_counts=True)
        a, b = first_longer[i : i + 2]
        found = np.concatenate((words, shared_stems(hashes[longer[a:b]], stems[a:b])))
        bins.append(np.unique((found & np.uint64(BINS - 1)).astype(np.int64)))
        if not len(own):
            continue
        letters = _LETTER[raw].sum()
        lines = text.split(b"\n")
        shapes[i] = (
            _SYMBOLS[raw].sum() / len(raw),
            (raw == 0x7C).sum() / len(own),
            _UPPER[raw].sum() / max(1, letters),
            counts.max() / len(own) if len(own) >= 20 else 0,
            1 - len(set(lines)) / len(lines) if len(lines) >= 5 else 0,
            max(0.0, 1 - len(words) / min(len(own), 400)) if len(own) >= 20 else 0,
        )
    return shapes, bins, insults


def shared_stems(words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Hashes, apart from those of words, of the stems that two different words have; stems[i] is that of words[i]."""
    _, at = np.unique(words, return_index=True)
    stems, n_words = np.unique(stems[at], return_counts=True)
    return mix(stems[n_words >= 2] + np.uint64(STEM))


def shape_votes(shapes: np.ndarray) -> np.ndarray:
    """One labeller a shape; all vote on every text, so those that pass contradict one that flags."""
    return np.where(shapes >= np.array(list(SHAPES.values())), FLAGS, PASSES).astype(np.int64)


def features(shapes: np.ndarray, bins: np.ndarray, insults: int) -> np.ndarray:
    """Binary features of one text: its word bins, the steps that its shapes reach, and whether it holds an insult."""
    steps = np.flatnonzero((shapes[:, None] >= STEPS[None, :]).ravel())
    return np.concatenate((bins, BINS + steps, [MARKS] * int(insults > 0))).astype(np.int32)


def holds(found: np.ndarray, mined: np.ndarray) -> np.ndarray:
    """Which of the features are among the mined bins (sorted)."""
    if not len(mined):
        return np.zeros(len(found), bool)
    return mined[np.minimum(np.searchsorted(mined, found), len(mined) - 1)] == found


def with_mined(found: list[np.ndarray], mined: np.ndarray) -> list[np.ndarray]:
    """Features with the marks of mined words."""
    hits = [np.count_nonzero(holds(f, mined)) for f in found]
    return [np.append(f, [MARKS + 1, MARKS + 2][: min(h, 2)]).astype(np.int32) for f, h in zip(found, hits, strict=True)]


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def votes_of(patterns: np.ndarray, n: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(n)) % 3


@dataclass
class LabelModel:
    """How often each labeller flags good (row 0) and bad (row 1) documents, and the share of bad ones."""

    flags: np.ndarray
    bad: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(bad) of rows of votes; labellers are independent given the class, one that was not asked says nothing."""
        log = np.log(np.array([1 - self.bad, self.bad]))[:, None] + np.zeros(len(votes))
        for j in range(votes.shape[1]):
            says = np.stack((np.zeros(2), np.log(self.flags[:, j]), np.log(1 - self.flags[:, j])), 1)
            log = log + says[:, votes[:, j]]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, known: np.ndarray, rounds: int = 60) -> LabelModel:
    """The labellers' model from weighted rows of votes; known is 0 good, 1 bad or 2 for each row.

    Known rows anchor the class: where there are 8 of both kinds at least, the
    labellers start from what they say on them, known rows keep their class, and
    all other rows together weigh half as much, so that the classes stay what
    the labels mean. Else labellers start as seldom wrong on good documents.
    """
    weight = weight.astype(float).copy()
    start = np.empty((2, votes.shape[1]))
    start[0], start[1] = 0.02, 0.45
    clear = np.stack((known == 0, known == 1)) * weight
    model, fixed = LabelModel(start, 0.15), np.zeros(len(votes), bool)
    if clear.sum(1).min() >= 8:
        model, fixed = LabelModel(_flag_rates(clear, votes, start, 1.0), clear[1].sum() / clear.sum()), known != 2
        others = weight[~fixed].sum()
        weight[~fixed] *= min(1.0, 0.5 * weight[fixed].sum() / max(others, 1.0))
    for _ in range(rounds):
        post = np.where(fixed, known == 1, model.posterior(votes))
        mass = np.stack((1 - post, post)) * weight
        model = LabelModel(_flag_rates(mass, votes, start, 5.0), (mass[1].sum() + 1) / (weight.sum() + 8))
    return model


def _flag_rates(mass: np.ndarray, votes: np.ndarray, start: np.ndarray, trust: float) -> np.ndarray:
    """Rates at which labellers flag, per class, from class weights of the rows and `trust` votes of the start."""
    flagged = mass @ (votes == FLAGS)
    asked = mass @ (votes != NOT_ASKED)
    return (flagged + trust * start) / (asked + trust)


@dataclass
class Scorer:
    """Weights of the chosen features (sorted) and a bias; score = 1 / (1 + exp(-sum))."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(found), self.bias)
        if len(self.chosen):
            for i, f in enumerate(found):
                at = np.minimum(np.searchsorted(self.chosen, f), len(self.chosen) - 1)
                out[i] += self.weights[at[self.chosen[at] == f]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    @classmethod
    def fit(cls, found: list[np.ndarray], label: np.ndarray, most: int = 1024, ridge: float = 0.5) -> Scorer:
        """Logistic regression on the features whose share differs most between bad and good, by Newton steps."""
        n, bad = len(found), label.sum()
        if n == 0 or bad < 0.5 or n - bad < 0.5:
            p = (bad + 0.01) / (n + 1)
            return cls(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
        flat = np.concatenate(found)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in found])
        held, with_bad = _counts(flat, label[owner])
        shape = np.arange(len(held)) >= BINS  # few, and made for this: taken whatever their share
        seen = np.flatnonzero((held >= 5) | shape & (held >= 2))
        held, with_bad, shape = held[seen], with_bad[seen], shape[seen]
        p1, p0 = with_bad / bad, (held - with_bad) / (n - bad)
        z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / bad + p0 * (1 - p0) / (n - bad) + 1 / (n * n) + 1e-12)
        pure = (with_bad >= 5) & (with_bad >= 0.8 * held)
        z = np.where(shape, np.inf, np.abs(np.where(pure, np.maximum(z, 4), z)))
        keep = np.flatnonzero(z >= 4)
        keep = np.sort(seen[keep[np.argsort(-z[keep], kind="stable")[:most]]])
        slot = np.full(MARKS + 3, -1, np.int32)
        slot[keep] = np.arange(len(keep))
        x = np.zeros((n, len(keep) + 1), np.float32)
        x[:, -1] = 1
        used = slot[flat] >= 0
        x[owner[used], slot[flat[used]]] = 1
        w = np.zeros(len(keep) + 1)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = np.zeros((len(w), len(w)))
            for a in range(0, n, 1000):  # in parts, so that no second copy of x is held
                part = x[a : a + 1000].astype(float)
                bend += (part * (p * (1 - p))[a : a + 1000, None]).T @ part
            step = np.linalg.solve(bend + np.diag(penalty), x.T @ (label - p) - penalty * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-4:
                break
        return cls(keep, w[:-1], float(w[-1]))


def mined_bins(found: list[np.ndarray], abusive: np.ndarray) -> np.ndarray:
    """Word bins that stand nearly only in texts known as abusive: of n of them, in 3 and in sqrt(n / 8) at least."""
    if not abusive.any():
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    held, hits = _counts(np.concatenate(found), abusive[owner].astype(np.float32))
    return np.flatnonzero((hits >= max(3, np.sqrt(abusive.sum() / 8))) & (hits >= 0.9 * held) & (np.arange(len(held)) < BINS))


def _counts(flat: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each feature is held, and the weight of its holders."""
    return np.bincount(flat, minlength=MARKS + 3), np.bincount(flat, weight, minlength=MARKS + 3)


_DESCRIBED = T.StructType([T.StructField("junk", T.IntegerType()), T.StructField("insults", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
_VOTES = T.StructType([T.StructField("junk", T.IntegerType()), T.StructField("abuse", T.IntegerType())])


@F.arrow_udf(_DESCRIBED)
def _described(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Shape votes as a pattern, the vote on insults, and features."""
    for texts in it:
        junk, abuse, found = [], [], []
        for _, some in batches(texts, 1 << 20):
            shapes, bins, insults = describe(some)
            junk += pattern_of(shape_votes(shapes)).tolist()
            abuse += np.where(insults > 0, FLAGS, PASSES).tolist()
            found += [features(*x) for x in zip(shapes, bins, insults, strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()))
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip((junk, abuse, found), kinds, strict=True)], _DESCRIBED.names)


def _voted(sent):
    """Patterns of the votes: shapes; insults and the words mined from each fold."""

    @F.arrow_udf(_VOTES)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicons = sent.value
        for texts in it:
            junk, abuse = [], []
            for _, some in batches(texts, 1 << 20):
                shapes, bins, insults = describe(some)
                junk += pattern_of(shape_votes(shapes)).tolist()
                hits = [insults > 0, *([holds(b, lex).any() for b in bins] for lex in lexicons)]
                abuse += pattern_of(np.where(np.stack(hits, 1), FLAGS, PASSES)).tolist()
            yield pa.StructArray.from_arrays([pa.array(junk, pa.int32()), pa.array(abuse, pa.int32())], _VOTES.names)

    return run


def _scored(sent):
    kind = T.StructType([T.StructField("junk", T.DoubleType()), T.StructField("abuse", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in it:
            a, b = [], []
            for _, some in batches(texts, 1 << 20):
                found = with_mined([features(*x) for x in zip(*describe(some), strict=True)], model.mined)
                a += model.junk.score(found).tolist()
                b += model.abuse.score(found).tolist()
            yield pa.StructArray.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["junk", "abuse"])

    return run


@dataclass
class Fitted:
    """Scorers, bins of words mined in two folds, per kind the label model of each fold, and what the sample's texts (by digest) got."""

    junk: Scorer
    abuse: Scorer
    mined: np.ndarray
    labellers: dict[str, list[LabelModel]]
    digests: np.ndarray
    posteriors: dict[str, np.ndarray]


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _fold(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(31)), F.lit(FOLDS)).cast("int")


def _sample(docs: DataFrame, known: DataFrame, n_known: int, sample: int, sample_features: int) -> tuple[DataFrame, pa.Table]:
    """The written sample, and what of it fits: about `sample` texts with `sample_features` features at most."""
    lean = docs.select("doc_id", "text").filter("doc_id is not null")
    n_rows = lean.select("doc_id").join(known.select("doc_id"), "doc_id").count() if n_known else lean.count()
    share = min(1.0, sample / max(1, n_rows))
    picked = lean.withColumn("h", _digest(F.col("text"))).withColumn("rank", F.xxhash64("h", F.lit(29)).bitwiseAND(F.lit((1 << 62) - 1))).filter(F.col("rank") < int(share * (1 << 62)))
    picked = picked.join(known, "doc_id") if n_known else picked.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    once = picked.groupBy("rank", "h").agg(F.any_value("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    taken = materialise(once.withColumn("d", _described("text")).select("rank", "h", "quality", "toxic", _fold(F.col("h")).alias("fold"), "d.*"), "sample")
    sizes = taken.select("rank", F.size("features").alias("n")).toArrow().sort_by("rank")  # about `sample` rows
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), sample_features, "right"))
    if fits < sizes.num_rows:
        taken_part = taken.filter(F.col("rank") < sizes["rank"][fits].as_py())
    else:
        taken_part = taken
    return taken, taken_part.toArrow().sort_by([("rank", "ascending"), ("h", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, sample_features: int = 12_000_000) -> Fitted:
    """Scorers of junk and abuse, trained on posteriors of the label model.

    labels has doc_id, quality and toxic, 0 or 1 or null; of repeated ids the
    worst label counts. Known labels fall into folds by a hash of the text. A fold
    mines words that stand nearly only in its abusive texts; "holds a word
    mined from fold k" is a labeller beside the shapes and the insults, and is
    not asked about documents whose labels fold k holds. For each fold a label
    model is fitted on the votes on all documents, with the labellers and the
    known labels of the other folds only. So the posterior that a document of the
    fold trains the scorers with never saw its own label, nor do its features
    mark words mined from it.

    `sample` bounds the labelled texts on which words are mined and the scorers
    trained, picked by a hash of the text, equal ones once; `sample_features`
    bounds their distinct words and shapes in all, so that long texts cannot
    fill the driver. Votes, and the label models, cover all documents. Without
    labels, documents picked by hash train on what the labellers agree on.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = materialise(known, "labels")
    taken, table = _sample(docs, known, known.count(), sample, sample_features)
    found = [f.values.to_numpy() for f in table["features"]] if table.num_rows else []
    fold = table["fold"].to_numpy()
    toxic = np.array([t == 1 for t in table["toxic"].to_pylist()], bool)
    lexicons = [mined_bins([found[i] for i in np.flatnonzero(fold == k)], toxic[fold == k]) for k in range(FOLDS)]
    sent = spark.sparkContext.broadcast(lexicons)  # at most sample_features / 3 numbers
    votes = docs.select("doc_id", _fold(_digest(F.col("text"))).alias("fold"), _voted(sent)("text").alias("v")).select("doc_id", "fold", "v.*")
    known_class = {"junk": 1 - F.col("quality"), "abuse": F.col("toxic")}
    golds = [F.coalesce(c.cast("int"), F.lit(2)).alias(f"{k}_known") for k, c in known_class.items()]
    votes = votes.join(known, "doc_id", "left").groupBy("junk", "abuse", "fold", *golds).count()
    counts = votes.toArrow()  # a row per pattern of votes, fold and classes: at most 3**6 * 2**4 * 27
    counts = counts.sort_by([(c, "ascending") for c in counts.column_names])
    patterns = {"junk": votes_of(counts["junk"].to_numpy(), len(SHAPES)), "abuse": votes_of(counts["abuse"].to_numpy(), 1 + FOLDS)}
    own = {"junk": votes_of(table["junk"].to_numpy(), len(SHAPES)), "abuse": np.where(np.stack([table["insults"].to_numpy() == FLAGS, *(np.array([holds(f, lex).any() for f in found], bool) for lex in lexicons)], 1), FLAGS, PASSES)}
    row_fold, weight = counts["fold"].to_numpy(), counts["count"].to_numpy().astype(float)
    models, labelled = {}, {}
    for kind, n in (("junk", len(SHAPES)), ("abuse", 1 + FOLDS)):
        gold = counts[f"{kind}_known"].to_numpy()
        asked = patterns[kind].copy()
        if kind == "abuse":
            asked[np.arange(len(asked)), 1 + row_fold] = np.where(gold != 2, NOT_ASKED, asked[np.arange(len(asked)), 1 + row_fold])
        models[kind], labelled[kind] = [], np.zeros(len(found))
        for k in range(FOLDS):
            use = [j for j in range(n) if kind == "junk" or j != 1 + k]
            model = expectation_maximisation(asked[:, use], weight, np.where(row_fold == k, 2, gold))
            models[kind].append(model)
            labelled[kind][fold == k] = model.posterior(own[kind][fold == k][:, use])
    marked = [None] * len(found)
    for k in range(FOLDS):
        rows = np.flatnonzero(fold == k)
        both = np.intersect1d(*(lexicons[j] for j in range(FOLDS) if j != k), assume_unique=True)
        for i, f in zip(rows, with_mined([found[i] for i in rows], both), strict=True):
            marked[i] = f
    junk, abuse = (Scorer.fit(marked, labelled[kind]) for kind in ("junk", "abuse"))
    for done in (known, taken):
        drop(done)
    often, times = np.unique(np.concatenate(lexicons), return_counts=True)
    return Fitted(junk, abuse, often[times >= FOLDS - 1], models, table["h"].to_numpy(), labelled)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 8_000, threshold: float = 0.5, name: str = "quality") -> DataFrame:
    """Add a struct `name` (in place of one): junk and abuse, the odds of each, and kept: both are under the threshold.

    Null and empty texts have no words; they are scored by the biases, and so
    kept unless bad ones prevail. A score depends on the text alone, so repeated
    rows, and different texts of one id, are each scored for themselves; ties in
    the choice of features go to the lower bin. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    scored = docs.withColumn(name, _scored(sent)("text"))
    kept = (F.col(f"{name}.junk") < threshold) & (F.col(f"{name}.abuse") < threshold)
    return scored.withColumn(name, F.col(name).withField("kept", kept))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, and which of them are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    junk, abuse = F.col("quality.junk"), F.col("quality.abuse")
    return scored.select("doc_id", "quality.kept", F.round(1 - F.greatest(junk, abuse), 6).alias("score"), F.round(junk, 6).alias("junk"), F.round(abuse, 6).alias("abuse"))
