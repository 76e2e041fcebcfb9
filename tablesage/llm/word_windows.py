"""Words of whole batches of texts as numbers, and windows of words as hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from tablesage.llm.shingles import mix

_STEPS = np.random.Generator(np.random.PCG64(21)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Numbers(dict):
    """A number for each distinct word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def numbered_words(texts: Sequence[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text (runs of anything but U+0020 and U+0009 to U+000D), their numbers in one array, and how many each text has."""
    numbers = Numbers()
    words = [text.split() for text in texts]  # bytes are split at these six characters alone
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.empty(int(counts.sum()), np.int64)
    at = 0
    for own in words:
        ids[at : at + len(own)] = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        at += len(own)
    return words, ids, counts


def window_hashes(ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all windows of ``width`` words within one text; equal hashes of 64 bits mean equal windows of one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(len(ids)) + width <= ends)
    with np.errstate(over="ignore"):
        value = mix(owner[starts].astype(np.uint64) + np.uint64(1))
        for j in range(width):
            value = mix((value ^ ids[starts + j].astype(np.uint64)) * _STEPS[j % len(_STEPS)])
    return starts, value


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more."""
    if not len(hashes):
        return np.zeros(0, bool)
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(twice, hashes)
    return twice[np.minimum(at, len(twice) - 1)] == hashes
