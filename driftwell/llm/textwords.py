"""Words, word hashes and five-word shingles of texts, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Hashes of so many words are kept at once in a Python worker; then the memo starts anew. It changes no result.
MEMO_WORDS = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, memoised."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size consecutive values."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    n = len(hashes) - size + 1
    # Doubling: runs of 1, 2, 4, ... values, put together to size.
    done, have, width, rest = None, hashes, 1, size
    factor = ODD
    reach = 0
    while rest:
        if rest & 1:
            part = have[reach : reach + n]
            done = part.copy() if done is None else mix(done * ODD + np.uint64(width)) + part
            reach += width
        rest >>= 1
        if rest:
            have = mix(have[:-width] * factor + np.uint64(width)) + have[width:]
            width *= 2
    return mix(done + np.uint64(size))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words; of a shorter text, one of all its words."""
    if 0 < len(hashes) < size:
        return windows(hashes, len(hashes))
    return windows(hashes, size)
