"""The perfect binary Golay code of length 23: nearby codewords of 23-bit words."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def remainder(words: np.ndarray) -> np.ndarray:
    """Of each 23-bit word, seen as a polynomial, divided by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        left ^= np.where((left >> bit) & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return left


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the error patterns that lead to nearby codewords, and how many there are.

    A word at distance 1 or 2 from its codeword has no other within 4. A word at
    distance 3 has five more at distance 4. Emitting all of these, two words
    that differ in at most two bits share one (tests go through all cases).
    """
    patterns = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    count = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    weight = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for w in range(5):
        sets = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), w)], dtype=np.int64)
        for pattern, s in zip(sets.tolist(), remainder(sets).tolist(), strict=True):
            if w < 4:
                patterns[s, 0], count[s], weight[s] = pattern, 1, w
            elif weight[s] == 3:
                patterns[s, count[s]] = pattern
                count[s] += 1
    return patterns, count


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word up to six 12-bit indices of nearby codewords, as (rows, 6) and the number in use."""
    patterns, count = error_patterns()
    s = remainder(words)
    return (words.astype(np.int64)[:, None] ^ patterns[s]) >> CHECK_BITS, count[s]
