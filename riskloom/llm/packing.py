"""Token sequences of a fixed length, filled by minimum bin slack."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.tokens import read_tokenizer

#: How the tokenizer files with word ends normalise and split a text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers among the characters up to U+017F, lower case.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Characters that every Unicode version normalises, lower-cases and splits alike, whatever stands beside them.
_PLAIN = "\\t\\n\\r\x20-\x7e\xa1-\xac\xae-įı-ſ"
#: Words that an encoder keeps with their ids, and the longest that is kept.
_KEPT, _LONGEST = 1 << 20, 40


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """ids of texts as the library gives them, with the words met so far kept with theirs.

    Where the file has the split above, a text of plain characters is cut into
    words here and each new word goes to the library's model. Any other text,
    and one that holds an added token, goes to the library as a whole.
    """

    def __init__(self, file: bytes):
        super().__init__()
        told = json.loads(file)
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.model = self.tokenizer.model
        split, level = {"Regex": _SPLIT}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            told.get("normalizer") == _NORMALIZER
            and told.get("post_processor") is None
            and len(parts) == 2
            and parts[0] == {"type": "Split", "pattern": split, "behavior": "Removed", "invert": True}
            and level.items() <= parts[1].items()
        )
        added = [re.escape(t["content"]) for t in told.get("added_tokens", [])]
        self.odd = re.compile("|".join([f"[^{_PLAIN}]", *added])).search
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in found], "<u4").tobytes()
        if len(word) <= _LONGEST:
            if len(self) >= _KEPT:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text, without special tokens of its ends."""
        if self.by_word and not self.odd(text):
            return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


def fill(counts: Counter, lengths: list[int], room: int) -> Counter:
    """The multiset of lengths, within their counts, whose sum comes closest to room without passing it.

    Bit s of a number tells whether some items sum to s. Items are added from
    the longest down (lengths is in rising order) until room itself is reached;
    the numbers before each item are kept, and read backwards they tell which
    items the best sum needs.
    """
    reach, steps, wanted, mask = 1, [], 1 << room, (2 << room) - 1
    for length in reversed(lengths[: bisect_left(lengths, room + 1)]):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach & wanted:
            break
    best, used = reach.bit_length() - 1, Counter()
    for length, before in reversed(steps):
        if not before >> best & 1:
            used[length] += 1
            best -= length
    return used


class Bins:
    """Pieces that wait for a window, by length, and the windows made of them.

    A piece is (id, start, ids, tokens of its document); a window is a list of
    pieces. Each window starts from the longest piece and takes the multiset
    that leaves the least slack; a multiset is used again as long as its counts
    last. Slack that no whole piece fits is filled with the head of a piece, so
    only the last window of a task can be short.
    """

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.lengths, self.waiting, self.n = capacity, Counter(), [], {}, 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if not self.counts[length]:
            insort(self.lengths, length)
            self.waiting[length] = []
        self.counts[length] += 1
        self.waiting[length].append(piece)
        self.n += 1

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.n -= 1
        piece = self.waiting[length].pop()
        if not self.counts[length]:
            del self.counts[length], self.waiting[length]
            self.lengths.remove(length)
        return piece

    def windows(self, keep: int) -> Iterator[list[tuple]]:
        """Full windows until at most `keep` pieces wait; the last one may be short where keep is 0."""
        while self.n > keep:
            longest = self.lengths[-1]
            self.counts[longest] -= 1
            used = fill(self.counts, self.lengths, self.capacity - longest)
            self.counts[longest] += 1
            used[longest] += 1
            slack = self.capacity - sum(k * n for k, n in used.items())
            if keep and slack and used.total() == self.n:  # all that wait are too few
                return
            times = 1 if slack else min(self.counts[k] // n for k, n in used.items())
            for _ in range(times):
                window = [self._take(k) for k, n in used.items() for _ in range(n)]
                if slack and self.lengths:  # all that wait are longer than the slack
                    window.append(self._head(slack))
                yield window

    def _head(self, length: int) -> tuple:
        doc, start, ids, total = self._take(self.lengths[0])
        self.add((doc, start + length, ids[4 * length :], total))
        return doc, start, ids[: 4 * length], total


def in_powers(window: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces of a short window in windows whose lengths are powers of two; pieces are cut where those end."""
    left = sum(len(p[2]) for p in window) // 4
    pieces = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            doc, start, ids, total = pieces.pop()
            if len(ids) > 4 * size:
                pieces.append((doc, start + size, ids[4 * size :], total))
                ids = ids[: 4 * size]
            out.append((doc, start, ids, total))
            size -= len(ids) // 4
        yield out


def _packer(file, capacity: int, end_id: int, hold: int, kind: pa.DataType):
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, end = _encoder(file.value), Bins(capacity), np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 33
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def windows() -> Iterator[list[tuple]]:
            for some in it:
                for doc, text in zip(some["id"].to_pylist(), some["text"], strict=True):
                    ids = encoder.ids(text.as_py() or "") + end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for at in range(0, whole, capacity):
                        yield [(doc, at, ids[4 * at : 4 * (at + capacity)], total)]
                    if whole < total:
                        bins.add((doc, whole, ids[4 * whole :], total))
                        if bins.n >= hold:
                            yield from bins.windows(hold // 2)
            for window in bins.windows(0):
                if sum(len(p[2]) for p in window) < 4 * capacity:
                    yield from in_powers(window)
                else:
                    yield window

        for window in windows():
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, total, next_id, offset))
                offset += n
                size += 4 * n
            next_id += 1
            if size > 4 << 20 or len(rows) >= 10_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, hold: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, dealt to sequences of at most `capacity` tokens: id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's tokens are those of the library without special tokens, then
    end_id; ids are little-endian unsigned 32-bit numbers. Tokens from the front
    fill whole sequences; what is left is packed by minimum bin slack among the
    `hold` such pieces that a task has at hand. A piece is cut where no multiset
    of pieces fills a window. What a task has at its end is cut into sequences
    whose lengths are powers of two, so that none needs padding.

    One pass, no shuffle: a task packs what it reads, so memory is bounded by
    `hold` pieces and the longest text, and a lost task is run again alone.
    sequence_id holds the partition's number and is not gapless over tasks.
    Null and empty texts have end_id alone; rows that repeat an id are documents
    of their own, null ids too; an empty table gives no rows. Other columns do
    not come along.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    file = read_tokenizer(docs.sparkSession, tokenizer_path)
    schema = f"id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_packer(file, capacity, end_id, hold, to_arrow_type(id_type)), schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids: each sequence's ids in order. A group has at most a sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
