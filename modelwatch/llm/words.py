"""Words and word k-gram hashes of texts, as UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII letters in lower case, digits, and all bytes beyond ASCII are of words; the rest separates.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fold(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes (rolled over whole arrays at once)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j:j + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


class HashSet:
    """Membership of many 64-bit hashes in a fixed sorted set, through a bit per 22-bit prefix first."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.sorted >> np.uint64(42)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in ``hashes`` of the members."""
        if not len(self.sorted):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == hashes[maybe]]
