"""Which of many strings each text contains: a trie walked from all places of a batch of texts at once.

The cost is a few steps a byte of text, whatever the number of strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the table of texts by strings that is held at once, and places walked from at once.
CELLS, PLACES = 1 << 24, 1 << 20


class Trie:
    """Nodes of the strings' bytes; the root is 0, and as no edge leads to it, 0 stands for none."""

    def __init__(self, keys: Sequence[str]):
        coded = [k.encode() for k in keys]
        used = sorted(set(b"".join(coded)))
        self.kind = np.zeros(256, np.int64)  # 0: in no string
        self.kind[used] = np.arange(1, len(used) + 1)
        self.kinds, self.n, self.depth = len(used) + 1, len(keys), max(map(len, coded), default=0)
        nodes: list[dict[int, int]] = [{}]
        for key in coded:
            at = 0
            for b in key:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                at = nodes[at][b]
        self.next = np.zeros((len(nodes), self.kinds), np.int32)
        for i, edges in enumerate(nodes):
            for b, j in edges.items():
                self.next[i, self.kind[b]] = j
        self.next, self.key = self.next.ravel(), np.full(len(nodes), -1, np.int32)
        for k, key in enumerate(coded):
            at = 0
            for b in key:
                at = nodes[at][b]
            self.key[at] = k


def contained(trie: Trie, texts) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of an Arrow array of texts, each with the place of its first text and a table: does the text hold the string?"""
    wide = texts.cast("large_string")
    if not len(wide):
        return
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8)[: ends[-1]] if held else np.zeros(0, np.uint8)
    data = np.concatenate([data, np.zeros(trie.depth, np.uint8)])
    rows = max(1, CELLS // max(1, trie.n))
    for first in range(0, len(wide), rows):
        own = ends[first : first + rows + 1]
        seen = np.zeros((len(own) - 1, trie.n), bool)
        if trie.key[0] >= 0:
            seen[:, trie.key[0]] = True
        for low in range(int(own[0]), int(own[-1]), PLACES):
            _walk(trie, data, own, low, min(low + PLACES, int(own[-1])), seen)
        yield first, seen


def _walk(trie: Trie, data: np.ndarray, own: np.ndarray, low: int, high: int, seen: np.ndarray) -> None:
    """Marks the strings that begin at the places from low to high; those that leave their text are left out."""
    first = np.searchsorted(own, low, "right") - 1
    cuts = np.clip(own[first : np.searchsorted(own, high, "left") + 1], low, high)
    row_of = np.repeat(np.arange(first, first + len(cuts) - 1, dtype=np.int32), np.diff(cuts))
    kind = trie.kind[data[low : high + trie.depth]]
    node = trie.next[kind[: high - low]]
    at = np.flatnonzero(node).astype(np.int32)
    node, depth = node[at], 1
    while len(at):
        key = trie.key[node]
        hit = np.flatnonzero(key >= 0)
        row = row_of[at[hit]]
        inside = at[hit] + (low + depth) <= own[row + 1]
        seen[row[inside], key[hit][inside]] = True
        node = trie.next[node * trie.kinds + kind[at + depth]]
        on = np.flatnonzero(node)
        at, node, depth = at[on], node[on], depth + 1


def with_contained(rows: DataFrame, column: str, keys: Sequence[str], name: str) -> DataFrame:
    """rows, each with the places in keys of the strings that its text contains; rows of null texts are left out."""
    import pyarrow as pa

    trie = rows.sparkSession.sparkContext.broadcast(Trie(keys))

    def run(batches):
        for batch in batches:
            for first, seen in contained(trie.value, batch.column(column)):
                row, key = np.nonzero(seen)
                cuts = np.searchsorted(row, np.arange(len(seen) + 1)).astype(np.int32)
                part = batch.slice(first, len(seen))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, key.astype(np.int32))], [*part.schema.names, name])

    schema = rows.limit(0).withColumn(name, F.array().cast("array<int>")).schema
    return rows.filter(F.col(column).isNotNull()).mapInArrow(run, schema)


def counts_of_contained(rows: DataFrame, column: str, group: str, keys: Sequence[str]) -> DataFrame:
    """place in keys, n_rows and n_groups of each string that a text contains: how many texts, and texts of how many groups.

    A task sends on its sums, and a bit a string for each run of rows of one
    group. Bits of one group are merged by a plain aggregate, so neither a
    group's rows nor pairs of groups and strings are gathered or shuffled.
    """
    import pyarrow as pa

    from riskloom.sources.store import checkpointed

    spark, words = rows.sparkSession, max(1, -(-len(keys) // 64))
    trie = spark.sparkContext.broadcast(Trie(keys))
    some = rows.filter(F.col(column).isNotNull()).select(F.col(group).alias("own"), F.col(column).alias("text"))
    own_type = some.schema["own"].dataType.simpleString()

    def run(batches):
        n_rows, like = np.zeros(trie.value.n, np.int64), None
        for batch in batches:
            like = batch.schema.field("own").type
            for first, seen in contained(trie.value, batch.column("text")):
                n_rows += np.count_nonzero(seen, axis=0)
                own = batch.column("own").slice(first, len(seen))
                runs = _starts(own)
                bits = np.zeros((len(runs), words * 8), np.uint8)
                packed = np.packbits(seen, axis=1, bitorder="little")
                bits[:, : packed.shape[1]] = np.bitwise_or.reduceat(packed, runs, axis=0)
                masks = bits.view("<i8")
                lists = pa.ListArray.from_arrays(np.arange(0, masks.size + 1, words, dtype=np.int32), masks.ravel())
                yield pa.RecordBatch.from_arrays([own.take(pa.array(runs)), lists, pa.nulls(len(runs), pa.list_(pa.int64()))], ["own", "mask", "n_rows"])
        if like is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, like), pa.nulls(1, pa.list_(pa.int64())), pa.array([n_rows], pa.list_(pa.int64()))], ["own", "mask", "n_rows"])

    told = checkpointed(some.mapInArrow(run, f"own {own_type}, mask array<long>, n_rows array<long>"))
    by_row = told.filter("n_rows is not null").select(F.posexplode("n_rows").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n_rows"))
    merged = told.filter("mask is not null and own is not null").groupBy("own").agg(*(F.bit_or(F.col("mask")[i]).alias(f"m{i}") for i in range(words)))
    masks = merged.select(F.array(*(f"m{i}" for i in range(words))).alias("mask"))
    by_group = masks.mapInArrow(_bit_sums, "key int, n long").groupBy("key").agg(F.sum("n").alias("n_groups"))
    return by_row.filter("n_rows > 0").join(F.broadcast(by_group), "key", "left").na.fill(0, ["n_groups"])  # a row for each of the keys


def _starts(own) -> np.ndarray:
    """Where runs of equal values begin."""
    import pyarrow.compute as pc

    codes = pc.fill_null(own.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _bit_sums(batches):
    """Sums of each bit of the masks of a task's rows."""
    import pyarrow as pa

    total = None
    for batch in batches:
        lists = batch.column("mask")
        if not len(lists):
            continue
        masks = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        sums = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total = sums if total is None else total + sums
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["key", "n"])
