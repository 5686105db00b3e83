"""Hashed words and word shingles, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get far outputs."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of a text's words; hashes of recent words are kept, so most cost a look-up."""

    LIMIT = 100_000

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.kept) > self.LIMIT:
            self.kept.clear()
        kept, digest = self.kept, xxhash.xxh3_64_intdigest
        for w in words:
            if w not in kept:
                kept[w] = digest(w)
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text with A to Z in lower case: runs of bytes other than space, tab, LF, VT, FF and CR."""
    return (text or "").encode("utf-8", "replace").lower().split()


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; for fewer words (but some), one for the whole sequence."""
    n = min(n, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
    return out
