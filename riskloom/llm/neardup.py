"""Near-duplicates: MinHash bands, sequential Bayesian pruning, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import connected_components
from riskloom.llm.scratch import drop, fresh, materialise
from riskloom.llm.words import SPACED, batches, mix, shingles, word_hashes

#: Signature: BANDS bands of ROWS hashes. A pair at similarity 0.8 shares no band with odds of 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time.
BATCH = 32
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_C = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Stands for a null id in joins.
_NO_ID = -(1 << 63)
#: Rows of wide columns (texts, coded sets) that a Python worker gets at a time.
_WIDE = 500


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text, as 64-bit hashes."""
    hashes, first, _, _ = word_hashes(texts, SPACED)
    values, at = shingles(hashes, first, n)
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES 32-bit minima per non-empty set, zeros for an empty one."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        values = np.concatenate([sets[i] for i in filled])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in filled])[:-1]))
        work = np.empty_like(values)
        for p in range(HASHES):
            np.multiply(values, _A[p], out=work)
            work += _C[p]
            out[filled, p] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch compared so far, the least matches at which P(similarity >= percent) is at least miss.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1),
    and P(J >= t) = P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of a and b that no batch of hashes has pruned."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= need]
    return alive


def _described(n: int):
    """UDF: text -> n_shingles, digest of the set, signature."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    @F.arrow_udf(kind)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            sizes, digests, sigs = [], [], []
            for _, some in batches(texts, 1 << 20):
                sets = shingle_sets(some, n)
                sizes += map(len, sets)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs += [r.tobytes() for r in signatures(sets)]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["n", "digest", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _unpruned(percent: int, miss: float):
    least = least_matches(percent, miss)

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        if len(a):
            out[may_be_similar(_matrix(a), _matrix(b), least)] = True
        return pa.array(out)

    return run


def _similar(n: int, percent: int):
    """UDF: are these two whole texts' shingle sets similar, exactly?"""

    @F.arrow_udf("boolean")
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, kept = None, np.zeros(0, np.uint64)
        for left, right in it:
            out = []
            for x, y in zip(left, right, strict=True):
                one, two = x.as_py().encode(), y.as_py().encode()
                if one != last:
                    last, kept = one, shingle_sets([one], n)[0]
                other = shingle_sets([two], n)[0]
                both = len(np.intersect1d(kept, other, assume_unique=True))
                union = len(kept) + len(other) - both
                out.append(100 * both >= percent * union and union > 0)
            yield pa.array(out, pa.bool_())

    return run


class _Search:
    """Candidates of one run and what verifies them."""

    def __init__(self, members: DataFrame, sigs: DataFrame, texts: DataFrame, n: int, percent: int, miss: float) -> None:
        self.members, self.sigs, self.texts = members, sigs, texts
        self.n, self.percent, self.miss = n, percent, miss
        self.links: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Make links of the pairs (a, b) that are similar."""
        one = self.sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        two = self.sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        pairs = pairs.join(two, "b").join(one, "a").filter(_unpruned(self.percent, self.miss)("sig_a", "sig_b")).select("a", "b")
        pairs = materialise(pairs, "pairs")
        one = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        found = pairs.join(two, "b").join(one, "a").filter(_similar(self.n, self.percent)("text_a", "text_b")).select("a", "b")
        self.links = materialise(found, "links", _WIDE)
        drop(pairs)

    def finish(self, few: int = 64, many: int = 128, most: int = 8192, most_bytes: int = 4 << 20) -> None:
        """Link what is still apart in a bucket, without a row per pair.

        The largest component of a bucket is its main one; members outside it
        are strays. Each member of buckets with one main component is written as
        its signature, what it shares with the text that the component is named
        after, one bit a shingle, and what it has besides. Strays and members
        are dealt into blocks, and every block of strays meets every block of
        members: signature batches prune by posterior bounds, then bits and maps
        bound the intersection, then it is counted. One link for each stray and
        other component is enough.

        A block has `few` strays or `many` members while a side has 64 blocks
        at most, then up to `most`; so a row is sent 64 times, or once for each
        `most` rows of the other side. Blocks are bounded by `most_bytes` too.
        """
        spark = self.texts.sparkSession
        components = connected_components(self.links)
        placed = self.members.join(components.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
        several = materialise(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"), "several")
        placed = materialise(placed.join(several, "key"), "placed")
        main = materialise(placed.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main")), "main")
        groups = materialise(placed.join(main, "key").select("main", "node", "c", "n").distinct(), "groups")
        for done in (several, placed, main):
            drop(done)
        stray = F.col("c") != F.col("main")
        held = 4 * HASHES + 128 + 8 * F.col("n")  # bytes of a row, at most
        per = groups.groupBy("main").agg(F.count("*").alias("all"), F.sum(held).alias("all_bytes"), F.count_if(stray).alias("out"), F.coalesce(F.sum(F.when(stray, held)), F.lit(0)).alias("out_bytes"))

        def blocks(n: str, size: str, block: int) -> Column:
            by_rows = F.least(F.ceil(F.col(n) / block), F.greatest(F.lit(64), F.ceil(F.col(n) / most)))
            return F.greatest(by_rows, F.ceil(F.col(size) / most_bytes), F.lit(1)).cast("long")

        sizes = materialise(per.select("main", blocks("out", "out_bytes", few).alias("n_out"), blocks("all", "all_bytes", many).alias("n_all"), F.ceil(F.greatest(F.col("all") / many, F.col("all_bytes") / most_bytes)).cast("long").alias("parts")), "sizes")
        salt = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of))
        dealt = groups.join(sizes, "main").withColumn("part", salt("parts", 1)).join(self.texts, "node").join(self.sigs, "node")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        named = sizes.select("main", upto("parts").alias("part")).join(self.texts.select(F.col("node").alias("main"), F.col("text").alias("main_text")), "main")
        coded = dealt.join(named, ["main", "part"]).select("main", "node", "c", "n", "sig", "n_out", "n_all", _coded(self.n)("text", "main_text").alias("code"))
        coded = materialise(coded.select("main", "node", "c", "n", "sig", "n_out", "n_all", "code.*"), "coded", _WIDE)
        payload = ["node", "c", "n", "sig", "common", "extra"]
        left = coded.filter(stray).select("main", salt("n_out", 2).alias("a"), upto("n_all").alias("b"), F.lit(0).alias("side"), *payload)
        right = coded.select("main", upto("n_out").alias("a"), salt("n_all", 3).alias("b"), F.lit(1).alias("side"), *payload)
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = left.unionByName(right).repartition(spread, "main", "a", "b").sortWithinPartitions("main", "a", "b", "side", "node")
        found = materialise(met.mapInArrow(_linked(self.percent, self.miss), "a long, b long"), "links", _WIDE)
        for done in (groups, sizes, coded):
            drop(done)
        self.links = self.links.unionByName(found)


CODE = T.StructType([T.StructField("common", T.BinaryType()), T.StructField("extra", T.BinaryType())])


def _coded(n: int):
    """UDF: a text's set as bits over another text's sorted set, and the shingles besides."""

    @F.arrow_udf(CODE)
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, base = None, np.zeros(0, np.uint64)
        for texts, mains in it:
            out = []
            for x, y in zip(texts, mains, strict=True):
                if (name := y.as_py().encode()) != last:
                    last, base = name, shingle_sets([name], n)[0]
                own = shingle_sets([x.as_py().encode()], n)[0]
                out.append((np.packbits(np.isin(base, own, assume_unique=True)).tobytes(), np.setdiff1d(own, base, assume_unique=True).tobytes()))
            cols = zip(*out, strict=True) if out else [[]] * 2
            yield pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in cols], CODE.names)

    return run


@dataclass
class _Block:
    """Rows of one side: nodes, components, set sizes, signatures, bits, maps of the rest, repeats in the maps and the rest."""

    node: np.ndarray
    c: np.ndarray
    size: np.ndarray
    sig: np.ndarray
    bits: np.ndarray
    maps: np.ndarray
    over: np.ndarray
    extra: list[np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> _Block:
        common = [np.frombuffer(c, np.uint8) for c in rows["common"].to_pylist()]
        bits = np.zeros((len(common), -(-max(map(len, common)) // 8) * 8), np.uint8)  # as long for all: the main text's set
        for i, c in enumerate(common):
            bits[i, : len(c)] = c
        extra = [np.frombuffer(e, np.uint64) for e in rows["extra"].to_pylist()]
        maps, over = np.zeros((len(extra), 256), np.uint8), np.zeros(len(extra), np.int64)
        for i, e in enumerate(extra):
            slots = np.unique((e >> np.uint64(53)).astype(np.int64))
            np.bitwise_or.at(maps[i], slots >> 3, (1 << (slots & 7)).astype(np.uint8))
            over[i] = len(e) - len(slots)
        return cls(rows["node"].to_numpy(), rows["c"].to_numpy(), rows["n"].to_numpy(), _matrix(rows["sig"]), bits.view(np.uint64), maps.view(np.uint64), over, extra)


def _links(left: _Block, right: _Block, done: list[set], percent: int, least: list[int]) -> Iterator[tuple[int, int]]:
    """Links between strays and members of other components; done has the components that each stray is linked with."""
    for i in range(len(left.node)):
        apart = np.flatnonzero((right.c != left.c[i]) & (right.node != left.node[i]))
        if not len(apart):
            continue
        open_ = apart[may_be_similar(right.sig[apart], np.broadcast_to(left.sig[i], (len(apart), HASHES)), least)]
        common = np.bitwise_count(right.bits[open_] & left.bits[i]).sum(1, dtype=np.int64)
        sizes, own = right.size[open_], left.size[i]
        bound = common + np.bitwise_count(right.maps[open_] & left.maps[i]).sum(1, dtype=np.int64) + np.minimum(right.over[open_], left.over[i])
        bound = np.minimum(bound, np.minimum(sizes, own))
        for k in np.argsort(-bound, kind="stable").tolist():
            j = open_[k]
            if 100 * bound[k] < percent * (sizes[k] + own - bound[k]) or right.c[j] in done[i]:
                continue
            both = common[k] + len(np.intersect1d(left.extra[i], right.extra[j], assume_unique=True))
            if 100 * both >= percent * (own + sizes[k] - both):
                done[i].add(right.c[j])
                yield int(left.node[i]), int(right.node[j])


def _linked(percent: int, miss: float):
    """Rows sorted by (main, a, b, side): the strays of a pair of blocks, then its members as they stream in."""
    least = least_matches(percent, miss)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, left, done = None, [], None, []
        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("main", "a", "b", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := tuple(keys[lo, :3].tolist())) != key:
                    key, held, left = now, [], None
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if keys[lo, 3] == 0:
                    held.append(part)
                elif held:
                    if left is None:
                        left = _Block.of(pa.concat_tables(held))
                        done = [set() for _ in left.node]
                    out += _links(left, _Block.of(part), done, percent, least)
            cols = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, n_shingles, component, component_id): components of texts whose n-word shingle sets are similar.

    One row for each row of docs. Sets are equal where digests are: such texts
    form a class, a node of the search with a number of its own. Classes that
    share a band of the signature are candidates. A bucket of many classes is
    not expanded into pairs: all compare with its first class, by signature
    batches and then exactly, and what still lies in different components is
    compared in blocks, by signature batches and then exactly. So a link between
    components is missed only by the odds of the bands, or of `miss`, the chance
    at which Bayesian pruning may drop a similar pair. Every link is confirmed
    on the full sets.

    A text with fewer than n words is one shingle; without words it is linked
    with nothing and has no component, its component_id is its own id. Texts are
    told apart by id and text (text_hash, 64 bits): an id may have several, each
    with links of its own, and rows that repeat both are copies. component_id is
    the least id of the component, null where all its ids are null; component
    tells components apart also then, but is another number in every run.
    """
    lean = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    found = materialise(lean.select("i", "h", "id", _described(n)("text").alias("d")).select("i", "h", "id", "d.*"), "described", _WIDE)
    classes = found.filter("n > 0").groupBy("digest").agg(F.min(F.struct("i", "h")).alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("id").alias("least"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = classes.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("key", "leader")
    buckets = materialise(buckets, "buckets")  # written, so that Spark can split a bucket of very many in the join
    members = materialise(bands.join(buckets, "key"), "members")
    wanted = materialise(members.select("node").distinct(), "wanted")
    sigs = materialise(classes.join(wanted, "node").select("node", "sig", "rep.i", "rep.h"), "sigs")
    texts = materialise(lean.join(sigs.select("node", "i", "h"), ["i", "h"]).groupBy("node").agg(F.min("text").alias("text")), "texts")
    search = _Search(members.select("key", "node", "n"), sigs.select("node", "sig"), texts, n, percent, miss)
    search.verify(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    search.finish()
    components = materialise(connected_components(search.links), "components")
    for done in (texts, sigs, members, wanted, buckets):
        drop(done)
    placed = classes.select("digest", "node", "least").join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed.select("digest", "component", "least"), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("digest", "component").join(least, "component")
    of = found.select("id", "h", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return of.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"), "component", own.alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: of the least id (null last), then text_hash, then of the other columns.

    Texts without words are no duplicates of any other and stay; rows that
    repeat id and text are copies there too.
    """
    found = near_duplicates(docs, n, percent, id_col=id_col, text_col=text_col)
    i, h = fresh(docs, "_i"), fresh(docs, "_h")
    mark = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("i"), F.col("text_hash").alias("h")]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), "text_hash")
    kept = found.filter("component is not null").groupBy("component").agg(F.min_by(F.struct(*mark), order).alias("k")).select("k.*")
    kept = kept.unionByName(found.filter("component is null").select(*mark)).distinct().select(F.col("i").alias(i), F.col("h").alias(h))
    named = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), h: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min(whole) if _ordered(docs.schema) else F.any_value(whole)
    return named.join(kept, [i, h], "left_semi").groupBy(i, h).agg(least.alias("row")).select("row.*")


def _ordered(kind: T.DataType) -> bool:
    """Whether Spark can compare values of this type."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 4-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, n=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
