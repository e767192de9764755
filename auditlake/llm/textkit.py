"""Vectorised words, word hashes and word shingles of many texts.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text. Hashes are of
64 bits, equal on every machine.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Odd constants of multiplicative mixing.
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLD + U(seed)) | U(1)


_BYTE = odd_constants(256, 11)
_PLACE = odd_constants(4096, 12)
_STEP = odd_constants(64, 13)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = ends - starts
    at = np.flatnonzero(inside)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(len(at)) - np.repeat(first, size)
    table = _PLACE if size.max() <= len(_PLACE) else odd_constants(int(size.max()), 12)
    hashes = np.add.reduceat(_BYTE[data[at]] * table[place], first)
    return mix(hashes + size.astype(np.uint64)), np.searchsorted(starts, begin)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of width words in a row; of all words where there are fewer; none of no words."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mix((words * _STEP[:n]).sum(keepdims=True) + U(n))
    out = words[: n - width + 1] * _STEP[0]
    for j in range(1, width):
        out = out + words[j : n - width + 1 + j] * _STEP[j]
    return mix(out + U(width))


def slices(batch, column: str = "text", chars: int = 1_000_000):
    """(first row, texts) of an Arrow batch, a bounded number of characters at a time; null texts are empty.

    A batch of whole rows (one struct column) has its text inside.
    """
    texts, start, size = [], 0, 0
    for i, t in enumerate(batch.column(column) if column in batch.schema.names else batch.column(0).field(column)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts
