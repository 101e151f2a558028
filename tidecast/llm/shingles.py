"""Word shingles of UTF-8 texts as 64-bit numbers, a batch of texts at a time."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import xxhash

WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return (text or b"").lower().split()


def hashed_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes, all texts in a row, and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(texts))
    codes, known = pd.factorize(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64), lengths


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j:j + n] * np.uint64(2 * (0x9E3779B97F4A7C15 * (j + 1) % 2**63) + 1)
    return mix(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sorting: faster here than np.unique's hashing)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: list[list[bytes]], width: int = WIDTH) -> list[np.ndarray]:
    """Per text its distinct shingles, sorted; with fewer words than ``width``
    the whole sequence is the one shingle; no words, no shingles."""
    hashes, lengths = hashed_words(texts)
    spans = windows(hashes, width)
    ends = np.cumsum(lengths)
    out = []
    for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        start = end - n
        if n >= width:
            out.append(distinct(spans[start:end - width + 1]))
        elif n:
            out.append(mix(windows(hashes[start:end], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
