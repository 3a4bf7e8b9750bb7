"""Words of many texts at once, as 64-bit hashes, with numpy only.

Texts of a batch are laid end to end, so that short ones cost little. A word
is a run of bytes that the table maps to other than 0; the table also folds
case. Equal words have equal hashes; different ones meet with odds of 2**-64
a pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: An odd multiplier, its inverse modulo 2**64, and the constants of a 64-bit finaliser.
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; works in place."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    for a, by in ((up, _B), (down, _B_INV)):
        done = 1
        while done < n:
            more = min(done, n - done)
            a[done : done + more] = a[:more] * np.uint64(pow(by, done, 1 << 64))
            done += more
    return up, down


_UP, _DOWN = _powers(1 << 12)
_UP, _DOWN = _UP[:0], _DOWN[:0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n, kept for reuse."""
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(max(n, _CHUNK + 4096))
    return _UP[:n], _DOWN[:n]


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B)) | np.uint64(1)


def byte_table(is_word) -> np.ndarray:
    """For each byte its folded form, 0 where it separates words."""
    return np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if is_word(b) else 0 for b in range(256)], np.uint8)


#: `[^\x20\x09-\x0D]+`, with A-Z folded. The NUL byte is a word's byte too, so it is given 0xFF, which UTF-8 never has.
SPACED = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
SPACED[0] = 0xFF
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are folded.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def word_hashes(texts: Sequence[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends): words of all texts; first[i] is where text i's words begin, first[-1] their number.

    starts and ends are byte offsets in the joined texts, one byte apart.
    """
    folded, first, starts, ends = word_ranges(texts, table)
    return range_hashes(folded, starts, ends), first, starts, ends


def word_ranges(texts: Sequence[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of the joined texts, first, starts, ends), as word_hashes() has them."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    folded = table[raw]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate(([0], np.cumsum(sizes + 1)))
    inside = folded != 0
    inside[text_at[1:] - 1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    return folded, np.searchsorted(starts, text_at), starts, ends


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for sorted ranges; in chunks, so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, "right")))
        high = int(ends[upto - 1])
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = upto
    return mix(out)


def hash_of(word: bytes, table: np.ndarray) -> int:
    """The hash that word_hashes() gives this one word."""
    return int(word_hashes([word], table)[0][0])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): n-word shingles of each text in order, repeats kept.

    A text of fewer words, but one at least, gives one shingle of all its words.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate(([0], np.cumsum(made)))
    total = len(hashes)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        acc *= np.uint64(_B_INV)
        acc += padded[k : k + total]
        acc ^= acc >> np.uint64(29)
    mix(acc)
    at = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    values = acc[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        x = np.uint64(0xD1B54A32D192ED03)
        for h in hashes[first[i] : first[i + 1]]:
            x = mix(np.array([(int(x) * _B + int(h)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        values[out_first[i]] = x
    return values, out_first


def batches(texts: Sequence, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about `most` bytes; null is empty."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.as_buffer().to_pybytes() if hasattr(t, "as_buffer") and t.is_valid else (t or b"") if not hasattr(t, "as_buffer") else b""
        if held and size + len(b) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, held


def lower(text: bytes) -> bytes:
    """Lower case of all letters, not only of A-Z."""
    return text if text.isascii() else text.decode().lower().encode()
