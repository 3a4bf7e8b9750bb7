"""Prefix trie of conversations by radix partitioning over turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.prefix import global_prefix
from riskloom.llm.scratch import drop, materialise

_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, pos (from 1), digest, words of each turn; turns go by turn (null first), equal ones by digest.

    digest is the SHA-256 of role and text, in which null counts as empty; two
    turns are the same if it is. Rows without an id are dropped, repeated rows
    are turns of their own. Positions come from ranks over all rows, so a long
    conversation lies in many partitions.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    lean = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col("turn").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    ranked = materialise(global_prefix(lean, [F.col("id"), F.col("turn"), F.col("digest")], {"rank": "one"}).select("id", "rank", "digest", "words"), "ranked")
    first = ranked.groupBy("id").agg(F.min("rank").alias("first"))
    return ranked.join(first, "id").select("id", (F.col("rank") - F.col("first") + 1).alias("pos"), "digest", "words")


def branched(turns: DataFrame, stem: int = 20, most: int = 3) -> DataFrame:
    """Sequences that share their first turns: id, pos, digest, words, and rows of null pos for sequences that come out empty.

    Sequence c takes the first h turns of c - c % stem, h = crc32(decimal c) %
    (most + 1), all if there are fewer, then its own turns after its first h.
    """
    own = turns.groupBy("id").agg(F.count("*").alias("n"))
    plan = own.select("id", "n", (F.col("id") - F.col("id") % stem).alias("base"), (F.crc32(F.col("id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    sizes = own.select(F.col("id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(sizes, "base", "left").withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
    stems = turns.filter(F.col("pos") <= most).withColumnRenamed("id", "base")
    heads = plan.filter("got > 0").select("id", "base", "got").join(stems, "base").filter("pos <= got").select("id", "pos", "digest", "words")
    tails = turns.join(plan.select("id", "h", "got"), "id").filter("pos > h").select("id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "words")
    bare = plan.filter("got = 0 and n <= h").select("id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words"))
    return heads.unionByName(tails).unionByName(bare)


def trie_nodes(members: list[tuple[int, list[int], list[int]]], depth: int, parent: int) -> list[list]:
    """Nodes of a group of sequences (id, codes, words) that lie under one node at `depth`, whose smallest member is parent.

    Multikey quicksort: a group is split by its codes at one place into less,
    equal and more. Less and more are sorted on at that place, equal is a node
    and is sorted on at the next place. Each node is emitted after its parent,
    so totals are added up backwards. Rows are as in _COLUMNS, then the place of
    the parent in the list, -1 for parent itself.
    """
    nodes: list[list] = []
    stack = [(members, 0, -1)]
    while stack:
        group, k, above = stack.pop()
        same = group
        if len(group) > 1:
            pivot = sorted((group[0][1][k], group[len(group) // 2][1][k], group[-1][1][k]))[1]
            same = [m for m in group if m[1][k] == pivot]
            if len(same) < len(group):
                for side in ([m for m in group if m[1][k] < pivot], [m for m in group if m[1][k] > pivot]):
                    if side:
                        stack.append((side, k, above))
        ended = sorted(m[0] for m in same if len(m[1]) == k + 1)
        rest = same if not ended else [m for m in same if len(m[1]) > k + 1]
        sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else _NOTHING
        up = nodes[above][0] if above >= 0 else parent
        if above >= 0:
            nodes[above][4] += 1
        nodes.append([min(m[0] for m in same), depth + k + 1, up, len(same), 0, 0, (len(same) - 1) * same[0][2][k], sha, above])
        if rest:
            stack.append((rest, k + 1, len(nodes) - 1))
    for node in reversed(nodes):
        if not node[4]:
            node[5] = 1
        if node[8] >= 0:
            nodes[node[8]][5] += node[5]
            nodes[node[8]][6] += node[6]
    return nodes


def _finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each bucket; rows come sorted by bucket (parent, depth, code), id and pos."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.bool_()]
    held, members, bucket = [], [], None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [*_COLUMNS, "top"])

    for some in it:
        for parent, depth, code, i, turn, words in zip(*(some[c].to_pylist() for c in ("parent", "depth", "code", "id", "turn", "words")), strict=True):
            if (parent, depth, code) != bucket:
                if members:
                    held += [(*n[:8], n[8] < 0) for n in trie_nodes(members, bucket[1], bucket[0])]
                bucket, members = (parent, depth, code), []
            if not members or members[-1][0] != i:
                members.append((i, [], []))
            members[-1][1].append(turn)
            members[-1][2].append(words)
        if len(held) > 10_000:
            yield batch()
            held = []
    if members:
        held += [(*n[:8], n[8] < 0) for n in trie_nodes(members, bucket[1], bucket[0])]
    if held:
        yield batch()


def _ends(ends: DataFrame) -> DataFrame:
    """id, depth, sha: SHA-256 of the decimal members that end at each node, ascending, joined by commas.

    Members are dealt by ranges; a range's members of a node become one text.
    The texts of a node are hashed in order as they stream by, so a node at
    which very many end takes a row a range, and no memory.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(ends.repartitionByRange(n, "member").withColumn("part", F.spark_partition_id()), "ends")
    text = F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",")
    texts = cut.groupBy("id", "depth", "part").agg(text.alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for some in it:
            done = []
            for i, depth, t in zip(*(some[c].to_pylist() for c in ("id", "depth", "text")), strict=True):
                if (i, depth) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (i, depth), hashlib.sha256(t.encode())
                else:
                    state.update(b"," + t.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["id", "depth", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["id", "depth", "sha"])

    return texts.repartition("id", "depth").sortWithinPartitions("id", "depth", "part").mapInArrow(run, "id long, depth long, sha string")


def _long(value: int | None) -> Column:
    return F.lit(value).cast("long")


def prefix_trie(sequences: DataFrame, local: int = 1 << 16, digits: int = 8) -> DataFrame:
    """The nodes of the trie of all sequences (id, pos, digest, words; null pos: an empty sequence), as in _COLUMNS.

    A node is known by its smallest member and its depth. Turns are encoded by a
    dictionary of all digests. From the root on, buckets of sequences that share
    a prefix are split by their next `digits` turns a round: MSD radix
    partitioning, by grouped counts and a join. A bucket with at most `local`
    turns and members is finished in one task by multikey quicksort; one of a
    single sequence needs no sorting at all. Only buckets above that go on to
    the next round, so rounds grow with the depth to which so many sequences
    agree. Totals of the large nodes are sums over what lies below their paths.

    Needs at least one sequence; none give no rows. A local bucket's turns are
    in one task's memory, nothing else is. Ties do not matter, as equal
    sequences are members of the same nodes.
    """
    told = sequences.filter("pos is not null")
    codes = materialise(told.groupBy("digest").agg(F.first("words").alias("words")).withColumn("code", F.monotonically_increasing_id()), "dictionary")
    turns = materialise(told.select("id", "pos", "digest").join(codes, "digest").select("id", "pos", "code", "words"), "turns")
    drop(codes)
    sizes = turns.groupBy("id").agg(F.count("*").alias("n"))
    empty = sequences.filter("pos is null").select("id", _long(0).alias("n"))
    members = materialise(sizes.unionByName(empty), "members")
    whole = members.agg(F.min("id"), F.count("*")).first()
    nodes_type = "id long, depth long, parent long, n_convs long, words long, path array<long>"
    root = sequences.sparkSession.createDataFrame([(whole[0], 0, None, whole[1], 0, [whole[0]])] if whole[1] else [], nodes_type)
    large, buckets = [root], []
    ends = [members.filter("n = 0").select(_long(whole[0]).alias("id"), _long(0).alias("depth"), F.col("id").alias("member"))]
    active, heads, depth = members.filter("n > 0").withColumn("at", _long(whole[0])), root.select("id", "path"), 0
    while True:
        split = _round(active, heads, turns, depth, local, digits)
        placed = split["placed"]
        ends.append(placed.filter("n = depth").select(F.col("deep").alias("id"), "depth", F.col("id").alias("member")))
        buckets.append(placed.filter((F.col("n") > F.col("depth")) & (F.col("depth") < depth + digits)).select(F.col("deep").alias("parent"), "depth", "code", "id", "n"))
        if split["large"] is None:
            break
        large.append(split["large"].select("id", "depth", "parent", "n_convs", "words", "path"))
        depth += digits
        heads = split["large"].filter(F.col("depth") == depth).select("id", "path")
        active = placed.filter((F.col("n") > F.col("depth")) & (F.col("depth") == depth)).select("id", "n", F.col("deep").alias("at"))
        if heads.isEmpty():
            break
    below = _union(buckets).withColumn("size", F.count("*").over(_over("parent", "depth", "code")))
    rows = materialise(below.join(turns.withColumnRenamed("code", "turn"), "id").filter("pos > depth"), "buckets")
    few = rows.filter("size > 1").repartition("parent", "depth", "code").sortWithinPartitions("parent", "depth", "code", "id", "pos")
    several = materialise(few.select("parent", "depth", "code", "id", "turn", "words").mapInArrow(_finish, ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _COLUMNS) + ", top boolean"), "several")
    last, first = F.col("pos") == F.col("n"), F.col("pos") == F.col("depth") + 1
    single = rows.filter("size = 1").select(
        F.col("id").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(first, F.col("parent")).otherwise(F.col("id")).alias("parent_conv_id"),
        _long(1).alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        _long(1).alias("n_leaves"),
        _long(0).alias("saved_tokens"),
        F.when(last, F.sha2(F.col("id").cast("string").cast("binary"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
        first.alias("top"),
    )
    small = several.unionByName(single)
    upper = _totals(_union(large), small.filter("top"), _ends(_union(ends)))
    return small.select(_COLUMNS).unionByName(upper.select(_COLUMNS))


def _over(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _round(active: DataFrame, heads: DataFrame, turns: DataFrame, depth: int, local: int, digits: int) -> dict[str, DataFrame | None]:
    """One round over sequences (id, n, at) that are longer than depth and share their first turns with node `at`.

    placed: each sequence with deep and depth, its deepest large node, and code,
    its next turn there. large: new large nodes, or None; heads has the paths of
    those at `depth`.
    """
    near = turns.filter(F.col("pos").between(depth + 1, depth + digits))
    step = F.sort_array(F.collect_list(F.struct("pos", "code", "words")))
    some = active.join(near, "id").groupBy("id", "n", "at").agg(step.alias("s"))
    read = materialise(some.select("id", "n", "at", F.col("s.code").alias("codes"), F.col("s.words").alias("words")), "digits")
    levels = read.select("id", "n", "at", F.explode(F.sequence(F.lit(1), F.size("codes"))).alias("j"), "codes", "words")
    levels = levels.select("id", "n", "at", "j", F.slice("codes", F.lit(1), F.col("j")).alias("key"), F.element_at("words", F.col("j")).alias("words"))
    grouped = levels.groupBy("at", "j", "key").agg(F.min("id").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("n") - depth - F.col("j")).alias("below"), F.min("words").alias("words"))
    large = materialise(grouped.filter((F.col("n_convs") > 1) & (F.col("n_convs") + F.col("below") > local)).drop("below"), "large")
    if large.isEmpty():
        placed = read.select("id", "n", F.col("at").alias("deep"), _long(depth).alias("depth"), F.element_at("codes", 1).alias("code"))
        return {"placed": placed, "large": None}
    met = levels.select("id", "at", "j", "key").join(large.select("at", "j", "key", "node"), ["at", "j", "key"])
    deepest = met.groupBy("id").agg(F.max("j").alias("m"), F.max_by("node", "j").alias("node"))
    known = read.join(deepest, "id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    placed = materialise(known.select("id", "n", F.coalesce("node", "at").alias("deep"), (F.col("m") + depth).cast("long").alias("depth"), F.get("codes", F.col("m")).alias("code")), "placed")
    up = large.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("j")))).withColumn("part", F.slice("key", F.lit(1), F.col("i")))
    above = large.select("at", F.col("j").alias("i"), F.col("key").alias("part"), F.col("node").alias("holder"))
    inner = F.transform(F.sort_array(F.collect_list(F.struct("i", "holder"))), lambda x: x.holder)
    paths = up.join(above, ["at", "i", "part"]).groupBy("at", "j", "key", "node", "n_convs", "words").agg(inner.alias("inner"))
    whole = paths.join(heads.withColumnRenamed("id", "at"), "at").withColumn("path", F.concat("path", "inner"))
    out = whole.select(F.col("node").alias("id"), (F.col("j") + depth).cast("long").alias("depth"), F.element_at("path", -2).alias("parent"), "n_convs", "words", "path")
    return {"placed": placed, "large": materialise(out, "nodes")}


def _totals(large: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """The large nodes as in _COLUMNS: their own words and what hangs below, summed along paths."""
    hung = tops.groupBy(F.col("parent_conv_id").alias("id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = large.filter("parent is not null").groupBy(F.col("parent").alias("id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = large.join(hung, ["id", "depth"], "left").join(inner, ["id", "depth"], "left").withColumn("n_children", zero("kids") + zero("more"))
    own = own.withColumns({"leaves": zero("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": zero("saved") + (F.col("n_convs") - 1) * F.col("words")})
    up = own.select(F.posexplode("path").alias("depth", "id"), "leaves", "saved")
    sums = up.groupBy("id", F.col("depth").cast("long").alias("depth")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    done = own.drop("leaves", "saved").join(sums, ["id", "depth"]).join(ends, ["id", "depth"], "left")
    return done.select(F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another."""
    turns = materialise(turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "sequences")
    return prefix_trie(branched(turns))


OP11_SQL = r"""
WITH RECURSIVE step(k, i, c) AS (SELECT k, 0, k FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos, g, w FROM (
    SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)
), b AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY conv_id),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) % 4 AS h
  FROM b CROSS JOIN crc
), g AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS got FROM c LEFT JOIN b ON b.conv_id = c.base),
r AS (
  SELECT g.conv_id, o.pos, o.g, o.w FROM g JOIN o ON o.conv_id = g.base AND o.pos <= g.got
  UNION ALL SELECT g.conv_id, o.pos - g.h + g.got, o.g, o.w FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos > g.h
), p AS (
  SELECT conv_id, 0 AS depth, '' AS k, 0 AS w FROM g
  UNION ALL SELECT conv_id, pos, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY pos)), w FROM r
), l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.depth, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id, depth) GROUP BY ALL),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS own FROM p GROUP BY depth, k),
u AS (SELECT n.depth, n.k, m.k AS up, m.conv_id AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n m ON m.depth = p.depth AND m.k = p.k),
ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS kids FROM u GROUP BY ALL),
s AS (
  SELECT p.depth, p.k, sum(n.own) AS saved, count(*) FILTER (WHERE ch.kids IS NULL) AS leaves
  FROM n LEFT JOIN ch USING (depth, k) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.parent AS parent_conv_id, n.n_convs, coalesce(ch.kids, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s USING (depth, k) LEFT JOIN u USING (depth, k) LEFT JOIN ch USING (depth, k) LEFT JOIN e USING (depth, k)
"""
