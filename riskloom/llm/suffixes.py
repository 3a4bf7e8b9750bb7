"""Repeated passages of whole corpora by longest-previous-factor arrays.

A suffix array of a corpus fits no machine, and only matches of `length` bytes
matter here. So suffixes are first dealt out by content: of the fingerprints of
the 32-byte strings in a window of `length` bytes the least one (the last, if
several are equal) is the window's anchor. Equal windows have equal anchors, so
all occurrences of a window meet under one key. A block is the union of the
windows that one anchor occurrence stands for. Equal blocks are counted by
fingerprint; what blocks of one key share in part is read from the array of
longest previous factors of their joined text. Blocks of a key that has very
many are dealt out again by anchors of longer strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.scratch import drop, fresh, materialise
from riskloom.llm.words import _VALUES, mix, powers

_GRAM = 32
_NO_ID = -(1 << 63)
#: Windows whose anchors are found at once; positions fit 20 bits.
_PART = 1 << 19
#: Bytes of blocks whose suffixes are ordered at once.
_TEXT = 4 << 20


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def gram_lengths(length: int) -> list[int]:
    """Lengths of the strings that anchors are chosen from: each leaves a block a quarter of the windows, the last leaves one."""
    windows, out = max(1, length - _GRAM + 1), []
    while windows > 1:
        out.append(length - windows + 1)
        windows //= 4
    return [*out, length]


def blocks(data: np.ndarray, length: int, gram: int = _GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor fingerprint, first window, windows) of each block of one text."""
    span = length - gram + 1
    low = (1 << 20) - 1
    for begin in range(0, len(data) - length + 1, _PART):
        part = data[begin : begin + _PART + length - 1]
        sums, down = _sums(part)
        grams = len(part) - gram + 1
        prints = mix((sums[gram:] - sums[:-gram]) * down[:grams])
        keyed = (prints & ~np.uint64(low)) | (np.uint64(low) - np.arange(grams, dtype=np.uint64))
        rows = -(-grams // span)
        table = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        table[:grams] = keyed
        table = table.reshape(rows, span)
        ahead = np.minimum.accumulate(table, 1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        windows = grams - span + 1
        least = np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows])
        at = (np.uint64(low) - (least & np.uint64(low))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield prints[at[first]], first + begin, np.diff(np.append(first, windows))


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, keys, levels): suffixes by their first `depth` bytes, equal ones by position.

    keys are the first 8 bytes of each suffix; levels are (bytes, ranks by so
    many first bytes) of the prefix doubling from 8 bytes, whose last step
    overlaps to end at depth.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : j + n]
    done = min(8, depth)
    key, levels = first >> np.uint64(8 * (8 - done)), []
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        levels.append((done, rank.astype(np.int32)))
        if done >= depth:
            return order, first, levels
        step = min(done, depth - done)
        key = rank * (n + 1)
        key[: max(0, n - step)] += rank[step:]
        done += step


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first `depth` bytes, equal ones by position, and their ranks."""
    order, _, levels = suffix_ranks(text, depth)
    return order, levels[-1][1]


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1.

    All open places follow the pointers of the places they point at, as all
    between is larger; what is open after many rounds is looked up by block.
    """
    back = np.arange(-1, len(x) - 1)
    open_ = np.arange(len(x))
    for _ in range(64):
        open_ = open_[back[open_] >= 0]
        open_ = open_[x[back[open_]] > x[open_]]
        if not len(open_):
            return back
        back[open_] = back[back[open_]]
    size = 1024
    least = np.minimum.reduceat(x, np.arange(0, len(x), size))
    for i in open_.tolist():
        at = int(back[i])
        while at >= 0:
            low = at - at % size
            inside = np.flatnonzero(x[low : at + 1] < x[i])
            if len(inside):
                at = low + int(inside[-1])
                break
            before = np.flatnonzero(least[: low // size] < x[i])
            at = int(before[-1]) * size + size - 1 if len(before) else -1
        back[i] = at
    return back


def _common(i: np.ndarray, j: np.ndarray, n: int, keys: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Bytes that suffixes i and j of a text of n bytes have in common, up to the depth of the last level."""
    depth, last = levels[-1]
    out = np.zeros(len(i), np.int64)
    for size, rank in levels[-2::-1]:  # a prefix shorter than depth holds each power of two once at most
        a, b = i + out, j + out
        inside = np.maximum(a, b) < n
        out += size * (inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]))
    a, b = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
    differ = keys[a] ^ keys[b]
    for k in range(1, 8):
        out += (differ >> np.uint64(64 - 8 * k)) == 0
    out = np.where(last[i] == last[j], depth, out)
    return np.minimum(np.minimum(out, depth), n - np.maximum(i, j))


def previous_factors(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sources) of the longest previous factors of the suffixes at `starts` (sorted), up to depth bytes.

    In suffix order the previous and the next smaller position of a suffix are
    the earlier suffixes most like it. The longer of what it has in common with
    each is its factor; the source is where that one begins, -1 for none.
    """
    order, keys, levels = suffix_ranks(text, depth)
    taken = np.zeros(len(text), bool)
    taken[starts] = True
    at = order[taken[order]]
    length, source = np.zeros(len(text), np.int64), np.full(len(text), -1)
    for places in (at, at[::-1]):  # in reverse, the previous smaller position is the next one
        near = previous_smaller(places)
        has = near >= 0
        i, j = places[has], places[near[has]]
        common = _common(i, j, len(text), keys, levels)
        longer = common > length[i]
        length[i[longer]], source[i[longer]] = common[longer], j[longer]
    return length[starts], source[starts]


def _twins(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of the windows at starts whose fingerprint another one has."""
    sums, down = _sums(text)
    prints = (sums[starts + length] - sums[starts]) * down[starts]
    order = np.argsort(prints, kind="stable")
    same = prints[order[1:]] == prints[order[:-1]]
    twin = np.zeros(len(starts), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return starts[twin]


def repeats(pieces: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece, windows that an earlier window equals, and those that any other equals.

    A window has an earlier match of `length` bytes if its longest previous
    factor is that long; what is such a factor's source has another equal one
    too. A fingerprint of every window first leaves out those that have no
    equal, and the text between.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    whole = np.zeros(len(text), bool)
    for a, n in zip(at[:-1], sizes, strict=True):
        whole[a : a + max(0, n - length + 1)] = True
    starts = np.flatnonzero(whole)
    starts = _twins(text, starts, length) if len(starts) > 1 else starts[:0]
    earlier, other = np.zeros(len(text), bool), np.zeros(len(text), bool)
    if len(starts):
        edges = np.zeros(len(text) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) > 0)  # windows stay whole, in their order
        factor, source = previous_factors(text[kept], np.searchsorted(kept, starts), length)
        long = factor >= length
        earlier[starts[long]] = True
        other[starts[long]] = True
        other[kept[source[long]]] = True
    return [earlier[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [other[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _intervals(flags: np.ndarray, base: int, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(base + int(a), base + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _find_blocks(length: int, gram: int):
    """Rows (id, t, b, text), text from byte b on, to one row per block: anchor, digest, place and windows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                cols: list[list] = [[], [], [], [], [], [], []]
                for i, t, b, text in zip(some["id"].to_pylist(), some["t"].to_pylist(), some["b"].to_pylist(), some["text"], strict=True):
                    raw = text.as_buffer() if text.is_valid else b""
                    if len(raw) < length:
                        continue
                    data, view = np.frombuffer(raw, np.uint8), memoryview(raw)
                    for prints, first, count in blocks(data, length, gram):
                        digests = [xxhash.xxh3_64_intdigest(view[p : p + n + length - 1]) for p, n in zip(first.tolist(), count.tolist(), strict=True)]
                        n = len(first)
                        for col, x in zip(cols, (prints.view(np.int64), np.array(digests, np.uint64).view(np.int64), np.full(n, i, np.int64), np.full(n, t, np.int64), np.full(n, b, np.int64), first + b, count.astype(np.int32)), strict=True):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "e", "id", "t", "b", "p", "n"])

    return run


def _cut(length: int):
    """Rows (id, t, b, text, parts) to one row per block with its bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 100):
                some = batch.slice(lo, 100)
                out: list[tuple] = []
                for i, t, b, text, parts in zip(some["id"].to_pylist(), some["t"].to_pylist(), some["b"].to_pylist(), some["text"], some["parts"].to_pylist(), strict=True):
                    raw = text.as_buffer()
                    out += [(x["h"], i, t, x["p"], x["c"], x["nd"], raw[x["p"] - b : x["p"] - b + x["n"] + length - 1].to_pybytes()) for x in parts]
                names = ["h", "id", "t", "b", "c", "nd", "text"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _first_of(keys: list[tuple]) -> list[int]:
    """Places of distinct keys in their order: rows that repeat id and text count once."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [k for j, k in enumerate(order) if j == 0 or keys[k] != keys[order[j - 1]]]


def _order_suffixes(length: int, keep: str):
    """Rows sorted by h; all of one h are in one partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = [rows[k] for k in _first_of([r[:4] for r in rows])]
        earlier, other = repeats([r[5] for r in rows], length)
        out = []
        for (_, i, t, p, c, _piece), a, o in zip(rows, earlier, other, strict=True):
            if keep == "none" and c > 1:
                continue  # all of it goes, with its copies
            out += [(i, t, s, e) for s, e in _intervals(a if keep == "first" else o, p, length)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "t", "s", "e"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in it:
            columns = [batch[c].to_pylist() for c in ("h", "id", "t", "b", "c", "text")]
            for row in zip(*columns, strict=True):
                if size >= _TEXT and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", group: int = 512) -> DataFrame:
    """(id, t, spans): bytes of each text covered by a string of `length` bytes that repeats.

    docs has id, t (a hash of the text) and text. keep="none" counts a string
    that also starts anywhere else, keep="first" only one that starts earlier,
    in order of id, hash and position. The blocks of a key with more than
    `group` distinct ones are dealt out again, by anchors of longer strings: few
    windows share one, and in the end a block is one window.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    rows, spans, cut = docs.withColumn("b", F.lit(0).cast("long")), None, []
    grams = gram_lengths(length)
    for gram in grams:
        pieces, found = _level(rows, length, gram, keep, group if gram < length else None)
        spans = found if spans is None else spans.unionByName(found)
        cut.append(pieces)
        rows = pieces.filter(F.col("nd") > group).select("id", "t", "b", "text")
        if gram == length or rows.isEmpty():
            break
    every = materialise(spans.groupBy("id", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")  # at most a text's windows
    for done in cut:
        drop(done)
    return every


def _level(rows: DataFrame, length: int, gram: int, keep: str, group: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks that share a key with others, with their text, and the spans found: of equal blocks, and of keys up to `group`."""
    key = ["id", "t", "b"]
    found = materialise(rows.mapInArrow(_find_blocks(length, gram), "h long, e long, id long, t long, b long, p long, n int"), "blocks")
    distinct = materialise(found.groupBy("h", "e").agg(F.count("*").alias("c"), F.min(F.struct("id", "t", "p", "n", "b")).alias("r")), "distinct")
    per_key = distinct.groupBy("h").agg(F.count("*").alias("nd"), F.sum("c").alias("all")).filter("all > 1")
    per_key = materialise(per_key, "keys")  # written, so that Spark can split a frequent key in the join
    shared = materialise(distinct.join(per_key.select("h", "nd"), "h").select("h", "e", "c", "nd", "r.*"), "shared")
    drop(distinct)
    drop(per_key)
    full = shared.filter("c > 1").select("h", "e", *(F.col(x).alias(f"r_{x}") for x in ("id", "t", "p")))
    copies = found.join(full, ["h", "e"])
    if keep == "first":
        copies = copies.filter("id <> r_id or t <> r_t or p <> r_p")
    whole = materialise(copies.select("id", "t", F.col("p").alias("s"), (F.col("p") + F.col("n") + (length - 1)).alias("e")), "copies")
    drop(found)
    parts = shared.filter("nd > 1").groupBy(key).agg(F.collect_list(F.struct("h", "p", "n", "c", "nd")).alias("parts"))  # at most a text's blocks
    pieces = rows.join(parts, key).mapInArrow(_cut(length), "h long, id long, t long, b long, c long, nd long, text binary")
    pieces = materialise(pieces, "pieces")
    drop(shared)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = pieces if group is None else pieces.filter(F.col("nd") <= group)
    near = small.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_order_suffixes(length, keep), "id long, t long, s long, e long")
    return pieces, materialise(near, "near").unionByName(whole)


RESULT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def _remove(bytes_too: bool):
    @F.arrow_udf(RESULT)
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in it:
            out = []
            for text, span in zip(texts, spans, strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                joined: list[list[int]] = []
                if span.is_valid:
                    begin, end = span.values.field("s").to_numpy(), span.values.field("e").to_numpy()
                    order = np.argsort(begin, kind="stable")
                    for s, e in zip(begin[order].tolist(), end[order].tolist(), strict=True):
                        if joined and s <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([s, e])
                sha, at, kept = hashlib.sha256(), 0, []
                for s, e in [*joined, [len(raw), len(raw)]]:
                    sha.update(raw[at:s])
                    if bytes_too:
                        kept.append(bytes(raw[at:s]))
                    at = e
                out.append((sum(e - s for s, e in joined), len(joined), sha.hexdigest(), b"".join(kept) if bytes_too else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], RESULT.names)

    return run


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first", group: int = 512, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Add _removed (in place of one): n_removed, n_spans, kept_sha256 and, if asked, the bytes kept.

    Texts are bytes in UTF-8, null is empty, matches never cross texts. See
    repeated_spans() for what is removed. Rows that repeat id and text are
    copies of each other; a null id counts as the smallest. Texts under
    `length` bytes, and empty tables, come back whole. Columns of docs stay.
    """
    i, t, held = (fresh(docs, n) for n in ("_id", "_t", "_spans"))
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), t: text_hash(F.col(text_col))})
    lean = keyed.select(F.col(i).alias("id"), F.col(t).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(lean, length, keep, group).select(F.col("id").alias(i), F.col("t").alias(t), F.col("spans").alias(held))
    joined = keyed.join(spans, [i, t], "left")
    return joined.withColumn("_removed", _remove(with_bytes)(F.col(text_col), held)).drop(i, t, held)


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without what repeats anywhere, by 400-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs, 400, "none", with_bytes=False)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", size.alias("n_bytes"), "_removed.n_removed", "_removed.n_spans", "_removed.kept_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 399)) AS p, h FROM d WHERE n >= 400),
m AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM w),
c AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM m WHERE k IN (SELECT k FROM m GROUP BY k HAVING count(*) > 1)),
i AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM c),
s AS (SELECT doc_id, g, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, g),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
