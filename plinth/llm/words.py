"""Words, shingles and their 64-bit hashes, for a whole Arrow batch at a time in numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; all other bytes of
UTF-8 stay as they are, so this equals the pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE = 0x9E6C63D0876A9A63  # an odd multiplier
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 19)
        for k, p in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            step = np.full(n, p, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; the number of words before each text, and their number."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and the number of words before each text."""
    starts, ends, word_offs = word_bounds(raw, offs)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((LOWER[raw].astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * ODD[0]), word_offs


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word (len - n + 1 of them, across texts)."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1] * ODD[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * ODD[k]
    return mix(out ^ U(n))


def shingle_sets(h: np.ndarray, word_offs: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text its sorted distinct n-gram hashes; a text of fewer words has its whole sequence as one."""
    all_grams = grams(h, n)
    out = []
    for a, b in zip(word_offs[:-1], word_offs[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
