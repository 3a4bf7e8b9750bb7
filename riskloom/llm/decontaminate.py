"""Benchmark decontamination: rare word pairs, or words of short items, as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import drop, fresh, materialise
from riskloom.llm.words import ALNUM, batches, lower, word_hashes

#: Scores of an alignment of words.
MATCH, MISMATCH, GAP = 2, -1, -1


def seed_words(length: int, threshold: float) -> int:
    """Words of a seed of an item: every alignment at the threshold holds a run of so many matches.

    An alignment of M matches without two in a row has M - 1 breaks at least,
    so it scores M + 1 at most; with 2 * threshold * n > n + 1 that is too little.
    """
    return 2 if length * (2 * threshold - 1) > 1 + 1e-9 else 1


def seeds_held(length: int, threshold: float) -> int:
    """How many of an item's seeds every alignment at the threshold holds at least, one at each of so many places.

    An alignment of M matches has 2M - 2 * threshold * n breaks at most, so of
    its M - 1 neighbours M - 1 - (2M - 2 * threshold * n) stay together, which
    is least where M = n. Single words are held at every match.
    """
    pairs = (2 * threshold - 1) * length - 1
    return max(1, math.ceil((pairs if seed_words(length, threshold) == 2 else threshold * length) - 1e-9))


@dataclass
class Seeds:
    """Runs of `size` words, as sorted codes; those of code i stand at item[first[i]:first[i + 1]], in the same place of offset."""

    size: int
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray


@dataclass
class Items:
    """A block of test items as word numbers, and where their rare seeds stand in them.

    Of the p seeds that every alignment of an item holds, see seeds_held(), the
    item's p // 2 most common ones (those that most items of the block have) are
    left out; the alignment still holds p - p // 2 of the others: needed.
    """

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    seeds: list[Seeds]
    counts: list[tuple[np.ndarray, np.ndarray]]
    lengths: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], threshold: float = 0.6, least: int = 3) -> Items:
        hashes, first, _, _ = word_hashes([lower((t or "").encode()) for _, t in rows], ALNUM)
        vocabulary = np.unique(hashes)
        numbers = np.searchsorted(vocabulary, hashes)
        words = [numbers[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        held = np.array([seeds_held(max(1, len(w)), threshold) for w in words], np.int64)
        seeds = []
        for size in (1, 2):
            own = [(k, _codes(w, len(vocabulary), size)) for k, w in enumerate(words) if len(w) >= least and seed_words(len(w), threshold) == size]
            distinct, n_items = np.unique(np.concatenate([np.unique(c) for _, c in own] or [np.zeros(0, np.int64)]), return_counts=True)
            code, item, offset = ([np.zeros(0, np.int64)] for _ in range(3))
            for k, c in own:
                rarest = np.argsort(n_items[np.searchsorted(distinct, c)], kind="stable")[: len(c) - held[k] // 2]
                code.append(c[rarest])
                item.append(np.full(len(rarest), k))
                offset.append(rarest)
            code, item, offset = (np.concatenate(x).astype(np.int64) for x in (code, item, offset))
            order = np.argsort(code, kind="stable")
            codes, starts = np.unique(code[order], return_index=True)
            seeds.append(Seeds(size, codes, np.append(starts, len(code)), item[order], offset[order]))
        return cls([i for i, _ in rows], words, vocabulary, seeds, [np.unique(w, return_counts=True) for w in words], np.array([len(w) for w in words], np.int64), held - held // 2)


def _codes(numbers: np.ndarray, base: int, size: int) -> np.ndarray:
    """One number for each run of `size` words; below 0 if a word is unknown (-1)."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(size):
        part = numbers[k : k + n]
        bad |= part < 0
        out = out * base + part
    return np.where(bad, -1, out)


def _slack(length: int) -> int:
    return max(4, length)


def _hits(numbers: np.ndarray, first: np.ndarray, seeds: Seeds, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the joined words, seed) of every seed in texts."""
    codes = _codes(numbers, base, seeds.size)
    if not len(seeds.codes) or not len(codes):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place = np.minimum(np.searchsorted(seeds.codes, codes), len(seeds.codes) - 1)
    hit = np.flatnonzero((seeds.codes[place] == codes) & (codes >= 0))
    text_of = np.searchsorted(first, hit, "right") - 1
    inside = hit + seeds.size <= first[text_of + 1]
    return text_of[inside], hit[inside], place[hit[inside]]


#: Places of seeds that are looked at together.
_TOGETHER = 1 << 21


def _begins(numbers: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, list[int]]]:
    """(text, item, sorted places where the item would begin) by text, for places that enough seeds agree on.

    The seeds that an alignment holds agree on where the item would begin up to
    its length, as it has fewer gaps than that. So a place stays if the places
    from it up to the item's length beyond are as many as are needed, or if it
    is one of these.
    """
    found = [(seeds, *_hits(numbers, first, seeds, len(items.vocabulary))) for seeds in items.seeds]
    n_places = np.zeros(len(first), np.int64)
    for seeds, text, _, s in found:
        np.add.at(n_places, text, np.diff(seeds.first)[s] if len(s) else 0)
    cuts = np.unique(np.searchsorted(np.cumsum(n_places), np.arange(_TOGETHER, n_places.sum() + _TOGETHER, _TOGETHER)))
    wide = int(items.lengths.max(initial=0)) + 1
    span = len(numbers) + 2 * wide  # a place and the next item's never meet
    low = 0
    for high in [*(cuts + 1).tolist(), len(first)]:
        keys = []
        for seeds, text, place, s in found:
            a, b = np.searchsorted(text, [low, high])
            size = np.diff(seeds.first)[s[a:b]]
            at = np.repeat(seeds.first[s[a:b]] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
            item = seeds.item[at]
            keys.append((np.repeat(text[a:b], size) * len(items.ids) + item) * span + np.repeat(place[a:b], size) - seeds.offset[at] + wide)
        low = high
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if not len(key):
            continue
        item = key // span % len(items.ids)
        upto = np.searchsorted(key, key + items.lengths[item], "right")
        begins = np.flatnonzero(upto - np.arange(len(key)) >= items.needed[item])
        marks = np.zeros(len(key) + 1, np.int64)
        np.add.at(marks, begins, 1)
        np.add.at(marks, upto[begins], -1)
        kept = key[np.cumsum(marks[:-1]) > 0]
        group = kept // span
        for part in np.split(np.arange(len(kept)), np.flatnonzero(np.diff(group)) + 1) if len(kept) else []:
            pair = int(group[part[0]])
            yield pair // len(items.ids), pair % len(items.ids), (kept[part] % span - wide).tolist()


def find_windows(texts: list[bytes], items: Items, threshold: float = 0.6) -> Iterator[tuple[int, list[tuple[int, int, list[int]]]]]:
    """(text, windows) for texts with enough seeds of an item; a window is (item, first word, word numbers).

    Every alignment at the threshold holds the seeds that Items.needed counts,
    and has fewer than as many words of the text too many as the item has words,
    so it lies in the window around their places, see _begins(). It matches
    threshold * n words at least; windows that share fewer with the item are
    left out. Seeds meet by sorted codes and are counted as arrays: the cost
    grows with the places of rare seeds, not with the number of items.
    """
    hashes, first, _, _ = word_hashes([lower(t) for t in texts], ALNUM)
    if not len(hashes) or not len(items.vocabulary):
        return
    at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    numbers = np.where(items.vocabulary[at] == hashes, at, -1)
    for t, group in groupby(_begins(numbers, first, items), key=lambda x: x[0]):
        low, high = int(first[t]), int(first[t + 1])
        windows = []
        whole = np.sort(numbers[low:high])
        for _, item, starts in group:
            length = len(items.words[item])
            own, times = items.counts[item]
            if np.minimum(np.searchsorted(whole, own, "right") - np.searchsorted(whole, own), times).sum() < threshold * length - 1e-9:
                continue
            cluster: list[int] = []
            for begin in [*starts, 1 << 60]:
                if cluster and begin - cluster[0] > length:
                    a = max(low, cluster[0] - _slack(length))
                    b = min(high, cluster[-1] + length + _slack(length))
                    inside_item = np.sort(numbers[a:b])
                    shared = np.searchsorted(inside_item, own, "right") - np.searchsorted(inside_item, own)
                    if np.minimum(shared, times).sum() >= threshold * length - 1e-9:
                        windows.append((item, a - low, numbers[a:b].tolist()))
                    cluster = []
                cluster.append(begin)
        yield t, windows


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window; pairs are padded and solved together."""
    n, wide, tall = len(items), max(map(len, windows), default=0), max(map(len, items), default=0)
    a, b = np.full((n, tall), -2), np.full((n, wide), -3)
    for k in range(n):
        a[k, : len(items[k])] = items[k]
        b[k, : len(windows[k])] = np.where(windows[k] < 0, -3, windows[k])
    row, best = np.zeros((n, wide + 1), np.int32), np.zeros(n, np.int32)
    slope = -GAP * np.arange(wide + 1, dtype=np.int32)
    for i in range(tall):
        step = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(new + slope, 1) - slope
        best = np.maximum(best, row.max(1))
    return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in runs of about `most` bytes; the driver holds one run at a time."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(id_col, text_hash, item_col, score): texts that hold a test item, or an edited copy.

    Words are runs of ASCII letters, digits and bytes over 0x7F, in lower case. The
    benchmark goes over all texts in blocks of bounded size. Seeds are an item's
    rarer pairs of words, or the words of an item so short that an edited copy
    may hold no pair; so many common ones are left out that every alignment at
    the threshold still holds a known number of the others, so none is lost.
    Windows around places where so many seeds agree, and that share enough words
    with the item, are aligned, equal windows once. score is the best alignment's share of the score of an exact copy.
    Items under `least` words (they are found everywhere) and null or empty
    texts match nothing; a row per text and item.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    out = None
    for rows in _blocks(benchmark, item_col, item_text_col, block_bytes):
        items = Items.of(rows, threshold, least)
        sent = spark.sparkContext.broadcast(items)  # about block_bytes
        found = materialise(lean.mapInArrow(_windows(sent, threshold), "id long, h long, windows array<struct<item: int, start: int, words: array<int>>>"), "seeds")
        windows = found.select("id", "h", F.explode("windows").alias("w")).select("id", "h", "w.item", "w.words")
        scored = windows.select("item", "words").distinct().mapInArrow(_aligned(sent, threshold), "item int, words array<int>, item_id long, score double")
        hits = windows.join(scored, ["item", "words"]).groupBy("id", "h", "item_id").agg(F.max("score").alias("score"))
        hits = materialise(hits, "hits")
        drop(found)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], "id long, h long, item_id long, score double")
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("item_id").alias(item_col), "score")


_WINDOW = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.int32()))]))


def _windows(sent, threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in it:
            ids, hashes = batch["id"].to_pylist(), batch["h"].to_pylist()
            for start, some in batches(batch["text"]):
                out = [(ids[start + t], hashes[start + t], [{"item": i, "start": a, "words": w} for i, a, w in windows]) for t, windows in find_windows(some, items, threshold) if windows]
                if out:
                    kinds = (pa.int64(), pa.int64(), _WINDOW)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "h", "windows"])

    return run


def _aligned(sent, threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                numbers = some["item"].to_pylist()
                queries = [items.words[i] for i in numbers]
                scores = smith_waterman(queries, [np.array(w, np.int64) for w in some["words"].to_pylist()])
                share = scores / (MATCH * np.array([max(1, len(q)) for q in queries]))
                good = pa.array(share >= threshold)
                names = pa.array([items.ids[i] for i in numbers], pa.int64())
                yield pa.RecordBatch.from_arrays([some["item"], some["words"], names, pa.array(share, pa.float64())], ["item", "words", "item_id", "score"]).filter(good)

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the texts that contaminated() reports; columns stay, null ids are told apart by their text."""
    hit_id, hit_hash = fresh(docs, "_hit_id"), fresh(docs, "_hit_hash")
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hit_hash))
    return docs.join(found, same, "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items and their scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"))
