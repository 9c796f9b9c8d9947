"""Hashes of all words of a byte buffer at once, by prefix sums of a polynomial modulo 2**64.

The hashes only route and group; whoever needs equality compares the bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEP + 1, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(_STEP, base, np.uint64))
    return out


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[starts[i]:ends[i]] for each i; starts ascend, words don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, at + _STEP, "right")))
            if j == i + 1 and ends[i] - at > _STEP:  # one word longer than a step
                h = np.uint64(0)
                for k in range(at, int(ends[i]), _STEP):
                    part = buf[k : min(k + _STEP, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                    h = h * _UP[_STEP] + np.sum(part * _UP[: len(part)], dtype=np.uint64)
                out[i] = h
            else:
                piece = buf[at : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(piece * _UP[: len(piece)], out=sums[1:])
                s, e = starts[i:j] - at, ends[i:j] - at
                out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
            i = j
    return mix(out)


def split_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the record of each, in lines of words joined by one space.

    Each record ends in a line feed. An empty record has no word.
    """
    seps = np.flatnonzero((buf == 32) | (buf == 10))
    starts = np.concatenate([[0], seps[:-1] + 1]) if len(seps) else np.zeros(0, np.int64)
    line = buf[seps] == 10
    record = np.cumsum(line) - line
    full = seps > starts
    return starts[full], seps[full], record[full]
