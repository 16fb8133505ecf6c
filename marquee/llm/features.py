"""Hashed word features for the text classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np

from marquee.llm import memo

_WORDS = re.compile(r"[^\W_]+").findall
#: Words a worker remembers the hashes of.
CACHE = 200_000

_hashes: dict[str, int] = memo.table()


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, in order."""
    return _WORDS((text or "").lower())


def word_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of each lower-case word of a text, in order."""
    found = words(text)
    memo.take(_hashes)
    if len(_hashes) > CACHE:
        _hashes.clear()
    for w in set(found).difference(_hashes):
        _hashes[w] = zlib.crc32(w.encode())
    get = _hashes.__getitem__
    return np.fromiter(map(get, found), np.uint64, len(found))


def mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of ``bits`` bits."""
    x = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def grams(h: np.ndarray, bits: int, order: int, skips: int) -> np.ndarray:
    """Distinct buckets of the word n-grams up to ``order`` and of the word pairs with 1 to ``skips`` words between."""
    found = [mixed(h, 1, bits)]
    joined = h
    for n in range(2, order + 1):
        joined = joined[:-1] * np.uint64(0x100000001B3) + h[n - 1 :] if len(h) >= n else joined[:0]
        found.append(mixed(joined, n, bits))
    for gap in range(2, skips + 2):
        if len(h) > gap:
            found.append(mixed(h[:-gap] * np.uint64(0x100000001B3) + h[gap:], 100 + gap, bits))
    return np.unique(np.concatenate(found))
