"""Licence scan: matching statistics over a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.words import ALNUM, batches, hash_of, word_hashes

#: Phrases whose words stand together, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that licences ask for, by label. Wording from the public licence texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
}

#: Whole licences, as published, by label.
LICENCES = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


@dataclass
class Automaton:
    """Accepts every run of tokens of its strings; knows where each state's longest run ends."""

    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state that runs through p by token end in, of length[p] + 1 at most."""
        q = self.moves[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(token) == q:
            self.moves[p][token] = clone
            p = self.link[p]
        return clone

    def _grow(self, last: int, token: int) -> int:
        if token in self.moves[last]:
            return self._split(last, token)
        made = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.moves[p]:
            self.moves[p][token] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, token)
        return made

    @classmethod
    def of(cls, strings: Sequence[Sequence[int]]) -> Automaton:
        a = cls()
        for s in strings:
            last = 0
            for token in s:
                last = a._grow(last, token)
        for k, s in enumerate(strings):
            at = 0
            for i, token in enumerate(s):
                at = a.moves[at][token]
                up = at
                while up > 0:
                    a.ends[up].append((k, i + 1))
                    up = a.link[up]
        return a

    def matches(self, tokens: Sequence[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(end, length, string, its ends) of each string's longest matches that cannot be extended in it.

        The state's strings match at full length, those of the states that it
        links to at the length of these. A string whose match did not grow by
        one has a match that ends before this token.
        """
        state, size = 0, 0
        held: dict[int, tuple[int, int]] = {}
        for i, token in enumerate(tokens):
            while state > 0 and token not in self.moves[state]:
                state = self.link[state]
                size = self.length[state]
            state, size = (self.moves[state][token], size + 1) if token in self.moves[state] else (0, 0)
            now: dict[int, tuple[int, int]] = {}
            up, long = state, size
            while long >= least:
                for k, _ in self.ends[up]:
                    now.setdefault(k, (long, up))
                up = self.link[up]
                long = self.length[up]
            yield from self._ended(held, now, i)
            held = now
        yield from self._ended(held, {}, len(tokens))

    def _ended(self, held: dict[int, tuple[int, int]], now: dict[int, tuple[int, int]], at: int) -> Iterator[tuple[int, int, int, list[int]]]:
        for k, (size, state) in held.items():
            if k not in now or now[k][0] != size + 1:
                yield at, size, k, [e for j, e in self.ends[state] if j == k]


class Scanner:
    """Templates and phrases as token ids, with what is needed to find them in batches."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int, cover: float) -> None:
        def words(text: str) -> list[bytes]:
            b = text.encode()
            _, first, starts, ends = word_hashes([b], ALNUM)
            return [b[s:e].lower() for s, e in zip(starts, ends, strict=True)]

        self.labels = [k for k, _ in templates]
        strings = [words(t) for _, t in templates]
        wanted = [words(p) for p, _ in phrases]
        vocabulary = sorted({w for s in [*strings, *wanted] for w in s})
        codes = np.array([hash_of(w, ALNUM) for w in vocabulary], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        ids = {vocabulary[j]: i for i, j in enumerate(order)}
        self.templates = [[ids[w] for w in s] for s in strings]
        self.phrases = [([ids[w] for w in s], label) for s, (_, label) in zip(wanted, phrases, strict=True)]
        self.automaton = Automaton.of(self.templates)
        self.least, self.cover = least, cover
        n = len(vocabulary)
        self.follows = np.zeros((n + 1, n + 1), bool)  # the last row and column are unknown words
        for s in self.templates:
            self.follows[s[:-1], s[1:]] = True

    def scan(self, texts: Sequence[bytes]) -> list[dict]:
        hashes, first, _, _ = word_hashes(texts, ALNUM)
        n = len(self.codes)
        at = np.minimum(np.searchsorted(self.codes, hashes), n - 1)
        ids = np.where(self.codes[at] == hashes, at, n).astype(np.int32) if len(hashes) else np.zeros(0, np.int32)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        out = [{"n_words": int(k), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []} for k in np.diff(first)]
        for phrase, label in self.phrases:
            k = len(phrase)
            if len(ids) < k:
                continue
            hit = np.ones(len(ids) - k + 1, bool)
            for j, w in enumerate(phrase):
                hit &= ids[j : len(ids) - k + 1 + j] == w
            for p in np.flatnonzero(hit):
                i = int(text_of[p])
                if text_of[p + k - 1] != i:
                    continue
                row, word = out[i], int(p - first[i])
                row["n_base"] += 1
                row["base"].add(label)
                row["first_word"] = word if row["first_word"] is None else min(row["first_word"], word)
                row["last_word"] = word if row["last_word"] is None else max(row["last_word"], word)
        # a match of `least` tokens lies in a run of pairs that follow each other in a template
        linked = self.follows[ids[:-1], ids[1:]] & (text_of[:-1] == text_of[1:]) if len(ids) > 1 else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False])).astype(np.int8)))
        runs: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a + 1 >= self.least:
                runs.setdefault(int(text_of[a]), []).append((int(a), int(b) + 1))
        for i, found in runs.items():
            self._chain(out[i], int(first[i]), found, ids)
        return out

    def _chain(self, row: dict, base: int, runs: list[tuple[int, int]], ids: np.ndarray) -> None:
        """Join long matches in the order of both text and template, while the text's gap stays below the template.

        Of a match that begins before the chain's end, in the text or in the
        template, only the words after it count. It opens another chain if it
        repeats all of this one, or if both reach the cover by themselves.
        """
        open_: dict[int, list[int]] = {}  # template: text start, text end, template end, covered words

        def close(k: int) -> None:
            start, end, _, covered = open_.pop(k)
            share = covered / len(self.templates[k])
            row["score"] = max(row["score"], share)
            if share >= self.cover:
                row["labels"].add(self.labels[k])
                row["spans"].append({"template": self.labels[k], "start_word": start, "end_word": end, "coverage": share})

        for a, b in runs:
            for end, size, k, places in self.automaton.matches(ids[a:b].tolist(), self.least):
                start, stop = a + end - size - base, a + end - base
                chain = open_.get(k)
                whole = len(self.templates[k])
                fit = []
                for e in places if chain else ():
                    over = max(0, chain[2] - (e - size), chain[1] - start)
                    again = over and min(chain[3], size) >= self.cover * whole
                    if over < min(size, chain[3]) and not again and start + over <= chain[1] + whole:
                        fit.append((over, e))
                if fit:
                    over, e = min(fit)
                    chain[1], chain[2], chain[3] = stop, e, chain[3] + size - over
                else:
                    if chain:
                        close(k)
                    open_[k] = [start, stop, min(places), size]
        for k in list(open_):
            close(k)


@lru_cache(maxsize=2)
def _scanner(templates, phrases, least: int, cover: float) -> Scanner:
    return Scanner(templates, phrases, least, cover)


SPAN = T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("coverage", T.DoubleType())]))
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", SPAN),
    ]
)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 4, cover: float = 0.6, text_col: str = "text") -> DataFrame:
    """Add a struct `license` to docs (in place of one): counts, labels, best coverage and spans.

    Words are runs of ASCII letters, digits and bytes over 0x7F, A-Z folded.
    Phrases are found at all their places. Texts then stream through a suffix
    automaton of the templates; matches of `least` words or more are chained
    into spans, and a template covered to `cover` or more adds its label. score
    is the best coverage of a template in one span. Spans count words from 0.
    Templates are the notices of TEMPLATES and the whole texts of LICENCES, if
    no others are given.
    Null and empty texts have no words, empty labels and score 0. There is no
    shuffle; templates are small parameters.
    """
    args = (tuple(sorted((templates or TEMPLATES | LICENCES).items())), tuple((phrases or PHRASES).items()), least, cover)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        scanner, kind = _scanner(*args), to_arrow_type(RESULT)
        for texts in it:
            rows = []
            for _, some in batches(texts):
                for r in scanner.scan(some):
                    base = r.pop("base")
                    rows.append(r | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | r["labels"]))})
            yield pa.array(rows, kind)

    return docs.withColumn("license", F.arrow_udf(run, RESULT)(F.col(text_col)))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and coverage of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *(F.col(f"license.{f.name}").alias(f.name) for f in RESULT.fields if f.name != "spans"))
