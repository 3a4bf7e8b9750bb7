"""Exact token counts of every prefix of a text, by dynamic programming.

For byte-level BPE the encoding of a prefix ends in exactly one token t such
that the encoding of what is before t, followed by t, holds together: BPE over
the bytes of (last token before, t) gives these two tokens again. So last[i]
follows from last[i - len(t)], and count[i] = count[i - len(t)] + 1. One pass
over a text gives the counts of all its prefixes, from which truncation and
budget questions are answered without another encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.scratch import fresh

#: Fixed value: the pre-tokenisation pattern of byte-level BPE.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces of a text whose prefixes fall apart into other pieces than a prefix of them.
CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes under a byte-level BPE file of the tokenizers library.

    Memory is bounded: about `pieces` pieces of up to 64 characters, in a newer
    and an older half, and `pieces` token pairs are remembered.
    """

    def __init__(self, file: bytes, pieces: int = 600_000) -> None:
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser or an added space is supported")
        if model.get("ignore_merges") or model.get("dropout") or model.get("unk_token"):
            raise ValueError("this BPE variant is not supported")
        code = _byte_alphabet()
        raw = lambda s: bytes(map(code.__getitem__, s))
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.merges: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[raw(a), raw(b)] = rank
        self.parts = {self.ids[a + b]: (self.ids[a], self.ids[b], rank) for (a, b), rank in self.merges.items()}
        if len(self.parts) != len(self.merges) or any(max(self.born(a), self.born(b)) >= rank for a, b, rank in self.parts.values()):
            raise ValueError("the merges do not build each token once, from earlier ones")
        self.crossing = {a << 20 | b: rank for a, b, rank in self.parts.values()}
        self.edges: tuple[dict, dict] = ({}, {})
        # a token counts only if BPE over its own bytes gives it
        self.tokens = {i: t for t, i in self.ids.items() if len(self.encode(t)) == 1}
        self.suffixes = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            self.suffixes.add_word(t.decode("latin-1"), (i, len(t)))
        self.suffixes.make_automaton()
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[int, bool] = {}
        self.deltas: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = pieces

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE: merge the adjacent pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.merges.get(pair, 1 << 60), i) for i, pair in enumerate(pairwise(parts))]
            rank, at = min(ranked)
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def born(self, token: int) -> int:
        """The rank of the merge that makes a token; -1 for a byte."""
        return self.parts[token][2] if token in self.parts else -1

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at a token's left (0) or right (1) end while it is built, with the ranks from and until which."""
        if (known := self.edges[side].get(token)) is None:
            known, at, until = [], token, 1 << 60
            while True:
                known.append((at, self.born(at), until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            self.edges[side][token] = known
        return known

    def holds(self, a: int, b: int) -> bool:
        """Does BPE over the bytes of tokens a and b give a and b?

        It doesn't if a merge across the border comes while both its sides stand
        there. Of equal merges that overlap the leftmost comes first.
        """
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            crossing, right = self.crossing, self.edge(b, 0)
            known = True
            for x, since, until in self.edge(a, 1):
                for y, since_y, until_y in right:
                    m = crossing.get(x << 20 | y, -1)
                    if since < m < until and since_y < m <= until_y:
                        known = False
            self.pairs[key] = known
        return known

    def byte_counts(self, piece: bytes) -> list[int]:
        """count[i] for each prefix piece[:i] taken as a piece of its own."""
        last, count, done = [-1], [0], -1
        pairs, holds = self.pairs, self.holds
        for end, (token, size) in self.suffixes.iter(piece.decode("latin-1")):
            if end == done:
                continue
            before = last[end + 1 - size]
            if before < 0:
                fits = True
            elif (fits := pairs.get(before << 20 | token)) is None:
                fits = holds(before, token)
            if fits:
                last.append(token)
                count.append(count[end + 1 - size] + 1)
                done = end
        if len(count) != len(piece) + 1:
            raise ValueError(f"no tokens cover {piece[:80]!r}")
        return count

    def piece_deltas(self, piece: str) -> bytes:
        """For each character, by how much the exact count grows: one signed byte."""
        if (known := self.older.get(piece)) is not None:
            self.deltas[piece] = known
            return known
        at = self.byte_counts(piece.encode("utf-8", "surrogatepass"))
        if not piece.isascii():
            ends = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]
            at = [at[e] for e in ends]
        if piece in CONTRACTIONS:  # cut short, they are a quote and then letters
            at[2] = 2
        steps = [b - a for a, b in pairwise(at)]
        if min(steps) < -128 or max(steps) > 127:
            raise OverflowError("a step of the token count does not fit a byte")
        known = bytes([x & 255 for x in steps])
        if len(piece) <= 64:
            if len(self.deltas) * 2 >= self.most:
                self.older, self.deltas = self.deltas, {}
            self.deltas[piece] = known
        return known

    def plain_steps(self, text: str) -> np.ndarray:
        """Steps of the counts of text[:1], text[:2], ... without added tokens."""
        pieces = PIECES.findall(text)
        known = self.deltas.get
        # get is bound once: what a renewal of the memory moves is found there again
        steps = np.frombuffer(b"".join([known(p) or self.piece_deltas(p) for p in pieces]), np.int8)
        fixes = []
        at = 0
        if "  " in text or _ODD_SPACE.search(text):
            # where white space ends, a prefix sees the run as one piece
            for a, b in pairwise(pieces):
                at += len(a)
                if _SPACE(a[-1]) and _SPACE(b[0]):
                    fixes.append((at, a + b[0]))
        if fixes:
            steps = steps.astype(np.int32)
            for at, run in fixes:
                start = self.byte_counts(run.encode())
                shift = start[-1] - (start[len(run[:-1].encode())] + int(steps[at]))
                steps[at] += shift
                if at + 1 < len(steps):
                    steps[at + 1] -= shift
        return steps

    def counts(self, text: str) -> np.ndarray:
        """counts[i] is the exact number of tokens of text[:i], for i from 0."""
        if not text:
            return np.zeros(1, np.int64)
        if self.split is None or not any(a in text for a in self.added):
            return np.concatenate(([0], np.cumsum(self.plain_steps(text), dtype=np.int64)))
        out, at, base = [np.zeros(1, np.int64)], 0, 0
        for m in self.split.finditer(text):
            # until its last character the added token is ordinary text after the segment
            seen = np.cumsum(self.plain_steps(text[at : m.end() - 1]), dtype=np.int64) + base
            before = int(seen[m.start() - at - 1]) if m.start() > at else base
            base = before + 1
            out += [seen, np.array([base])]
            at = m.end()
        if at < len(text):
            out.append(np.cumsum(self.plain_steps(text[at:]), dtype=np.int64) + base)
        return np.concatenate(out)


_ODD_SPACE = regex.compile(r"\s[^\S ]|[^\S ]\S")
_SPACE = regex.compile(r"\s").match


@lru_cache(maxsize=2)
def _counter(file: bytes) -> PrefixCounter:
    return PrefixCounter(file)


def read_tokenizer(spark, path: str):
    """The tokenizer's file, sent once to each executor; vocabularies have a few MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the tokenizer file is over 64 MB")
    return spark.sparkContext.broadcast(data)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text_col: str = "text", table: bool = False) -> DataFrame:
    """Add token_count, cut_chars and, if asked, token_steps to docs (in place of such columns).

    token_count is that of the whole text under the library's defaults, without
    begin, end or other added tokens; cut_chars is the number of characters of
    the longest prefix of at most `limit` tokens. token_steps holds the table:
    one signed byte a character, whose running sum is the exact count of each
    prefix (see tokens_at()). Null and empty texts have 0 tokens. Other columns
    stay; only the texts pass through Python.
    """
    file = read_tokenizer(docs.sparkSession, tokenizer_path)
    kind = T.StructType([T.StructField("token_count", T.LongType()), T.StructField("cut_chars", T.LongType()), T.StructField("token_steps", T.BinaryType())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(file.value)
        for texts in batches:
            total, cut, steps = [], [], []
            for text in texts:
                counts = counter.counts(text.as_py() or "")
                total.append(int(counts[-1]))
                fits = counts <= limit
                cut.append(int(len(fits) - 1 - np.argmax(fits[::-1])))
                steps.append(np.diff(counts).astype(np.int8).tobytes() if table else None)
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(cut, pa.int64()), pa.array(steps, pa.binary())], ["token_count", "cut_chars", "token_steps"])

    t = fresh(docs, "_t")
    counted = docs.withColumn(t, F.arrow_udf(run, kind)(F.col(text_col)))
    names = ["token_count", "cut_chars", *["token_steps"] * table]
    kept = [c for c in docs.columns if c.lower() not in names]
    return counted.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{t}.{n}").alias(n) for n in names))


def tokens_at(steps: Column, n_chars: Column) -> Column:
    """Tokens of the prefix of n_chars characters, from the stored steps alone."""

    @F.pandas_udf("long")
    def at(s, n):
        import pandas as pd

        return pd.Series([int(np.frombuffer(x, np.int8)[: max(0, k)].sum(dtype=np.int64)) for x, k in zip(s, n, strict=True)], dtype="int64")

    return at(steps, n_chars)


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("token_count").alias("n_tokens"),
        (F.col("token_count") > 1024).alias("over_limit"),
        "cut_chars",
    )
