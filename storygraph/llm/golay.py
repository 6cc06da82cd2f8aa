"""The perfect binary Golay code of 23 bits: decoding, and the codewords near a word."""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS = 23
NEAR = 6  # codewords within distance 4 of any word: 1 or 6


def _remainders(words: np.ndarray) -> np.ndarray:
    """The 11 check bits of words of 23 bits: the remainder by the generator."""
    rest = words.copy()
    for bit in range(BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def _leaders() -> np.ndarray:
    """The error of at most 3 bits that each remainder stands for; the code is perfect, so there is exactly one."""
    bits = [1 << i for i in range(BITS)]
    errors = [0, *bits]
    errors += [bits[i] | bits[j] for i in range(BITS) for j in range(i)]
    errors += [bits[i] | bits[j] | bits[k] for i in range(BITS) for j in range(i) for k in range(j)]
    table = np.zeros(2048, dtype=np.int64)
    table[_remainders(np.array(errors, dtype=np.int64))] = errors
    return table


def centre(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the only codeword within distance 3 of each word."""
    words = words.astype(np.int64)
    return (words ^ _leaders()[_remainders(words)]) >> 11


@cache
def _offsets() -> np.ndarray:
    """For each remainder, the codewords within distance 4 relative to the nearest one; -1 fills up.

    A word at distance 3 has five further codewords at distance 4: those of weight 7 that
    hold its error. At a smaller distance there is none.
    """
    index = np.arange(4096, dtype=np.int64) << 11
    codewords = index ^ _remainders(index)
    weight7 = codewords[np.bitwise_count(codewords) == 7]
    out = np.full((2048, NEAR), -1, dtype=np.int64)
    for rest, error in enumerate(_leaders()):
        out[rest, 0] = 0
        if int(error).bit_count() == 3:
            out[rest, 1:] = weight7[(weight7 & error) == error] >> 11
    return out


def near(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within distance 4 of each word, one row of 6 each, -1 where there are fewer.

    Two words at distance 2 or less share one: their midpoint is within 3 of a codeword, so
    both are within 4 of it.
    """
    words = words.astype(np.int64)
    rest = _remainders(words)
    first = (words ^ _leaders()[rest]) >> 11
    offsets = _offsets()[rest]
    return np.where(offsets < 0, -1, offsets ^ first[:, None])
