"""Word shingles as sorted 64-bit hashes, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Fixed odd multipliers of the words of a shingle.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers; another order of them for each salt."""
    h = values ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A-Z lower-cased, words cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each ``size`` words in a row, in order of position; one for all when there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mixed(np.array([np.bitwise_xor.reduce(mixed(words + np.arange(1, n + 1, dtype=np.uint64)))], np.uint64), n)
    total = words[: n - size + 1] * MULTIPLIERS[:1]
    for j in range(1, size):
        total = total + words[j : n - size + 1 + j] * (MULTIPLIERS[j % 5 : j % 5 + 1] * np.uint64(2 * (j // 5) + 1))
    return mixed(total)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))
