"""Sets of hashed word shingles of whole batches of texts, by array arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: White space between words, and how A-Z is lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_RANDOM = np.random.Generator(np.random.PCG64(20))
#: A random odd 64-bit number for each byte, and the odd base of the rolling hash with its inverse.
_BYTES = _RANDOM.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = _RANDOM.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(factors, dtype=np.uint64)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, and of all, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Sequence[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingle hashes of each text, ascending, one text after the other.

    Words are runs of anything but white space, with A to Z lower-cased. A text with fewer than ``size`` words has one
    shingle of all its words; one without words has none. Hashes have 64 bits.
    """
    data = np.frombuffer(b"".join([b" " + t.encode("utf-8", "surrogatepass") for t in texts]).translate(LOWERED), np.uint8)
    lengths = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    ends_of_texts = np.cumsum(lengths)
    blank = SPACE[data]
    edge = np.diff(blank.astype(np.int8), append=1)
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    with np.errstate(over="ignore"):
        rolled = _sums(np.where(blank, np.uint64(0), _BYTES[data]) * _powers(_BASE, len(data)))
        words = mix((rolled[ends] - rolled[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
        owner = np.searchsorted(ends_of_texts, starts, "right")
        per_text = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(per_text) - per_text
        short = np.minimum(per_text, size)  # words in a shingle of each text
        number = np.where(per_text > 0, per_text - short + 1, 0)
        who = np.repeat(np.arange(len(texts)), number)
        at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + first[who]
        value = short[who].astype(np.uint64)
        for j in range(size):
            value = np.where(j < short[who], mix(value * _STEPS[j] + words[np.minimum(at + j, max(len(words) - 1, 0))]) if len(words) else value, value)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[new], np.bincount(who[new], minlength=len(texts))


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each set, the same for equal sets; 0 for the empty one."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(counts)
        total = _sums(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)))
        ids = mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * np.uint64(_BASE))
    return np.where(counts > 0, ids, 0).astype(np.uint64).view(np.int64)
