"""Vectorised word and segment hashing over UTF-8 buffers (numpy, no Python loop over words)."""

from __future__ import annotations

import numpy as np

#: Fixed odd multiplier of the positional hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte; the folded table gives A-Z the values of a-z.
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

#: White space of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        for slot, base in enumerate((BASE, BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[slot] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data))
    values = (FOLDED_VALUES if folded else BYTE_VALUES)[data]
    values *= power[: len(data)]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of each row data[offsets[i]:offsets[i+1]]."""
    starts, ends = _spans(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: A space begins a segment if the next byte can't be or begin white space of any kind.
_CLEAR_NEXT = np.ones(256, bool)
_CLEAR_NEXT[:33] = False
_CLEAR_NEXT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of stretches that each begin at a row's start or at a space before a visible character.

    Pre-tokenizers that attach one leading space to a word never reach across such a place.
    """
    first = np.zeros(len(data), bool)
    first[:-1] = (data[:-1] == 32) & _CLEAR_NEXT[data[1:]]
    full = offsets[1:] > offsets[:-1]
    last = offsets[1:][full] - 1
    first[last] = False  # the next byte belongs to another row
    first[offsets[:-1][full]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
