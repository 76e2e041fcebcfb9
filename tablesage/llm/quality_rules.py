"""Quality rules: counts of words, signs and repetitions, and zstandard ratios held against bands by length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesage.llm.common import beside, quoted, slices
from tablesage.llm.word_windows import bytes_of, numbered_words, repeated, window_hashes

#: The signs that are counted, all below U+0080.
SYMBOLS = b"#*$%&|<>"
#: White space, and bytes that continue a character in UTF-8; all others begin one of a word.
NO_CHARACTER = b"\t\n\x0b\x0c\r " + bytes(range(0x80, 0xC0))
#: (bytes from, lowest ratio, highest ratio). Compression finds more in longer texts: natural text keeps between about 1.0 at
#: 64 bytes and 3 at 64 kB in alphabetic scripts; random letters and digits stay below 1.35, repeated lines soon exceed 4.
BANDS = [(0, 0.0, 3.0), (64, 0.8, 3.0), (256, 1.1, 3.5), (1024, 1.35, 4.0), (4096, 1.4, 4.5), (16384, 1.4, 5.0), (65536, 1.4, 6.0)]
#: Bytes of a chunk, compression level, and the share of a text's bytes in chunks outside the bands above which it is rejected.
CHUNK, LEVEL, BAD_SHARE = 4096, 3, 0.3
#: Words that a text needs, words of a window, and percent of words that may lie in repeated windows.
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: Bytes of text that are counted together.
TOGETHER = 4_000_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [
    *[(name, T.LongType()) for name in COUNTS], ("base_failed", T.BooleanType()), ("whole_ratio", T.DoubleType()),
    ("bad_chunk_share", T.DoubleType()), ("kept", T.BooleanType()),
]


def band_of(size: int, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """Lowest and highest ratio for so many bytes."""
    _, low, high = max((b for b in bands if b[0] <= size), default=(0, 0.0, float("inf")))
    return low, high


def compression(data: bytes, compressor: zstandard.ZstdCompressor, chunk: int, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float, bool]:
    """(ratio of the whole text, share of its bytes in chunks outside their bands, whether the whole is inside its band)."""
    if not data:
        return 0.0, 0.0, True
    ratio = len(data) / len(compressor.compress(data))
    low, high = band_of(len(data), bands)
    inside = low <= ratio <= high
    if len(data) <= chunk:
        return ratio, 0.0 if inside else 1.0, inside
    bad = 0
    for at in range(0, len(data), chunk):
        piece = data[at : at + chunk]
        least, most = band_of(len(piece), bands)
        if not least <= len(piece) / len(compressor.compress(piece)) <= most:
            bad += len(piece)
    return ratio, bad / len(data), inside


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each text, words in windows that occur twice or more in it."""
    starts, hashes = window_hashes(ids, counts, window)
    inside = np.zeros(len(ids) + window, np.int64)
    twice = starts[repeated(hashes)]
    inside[twice] += 1
    inside[twice + window] -= 1
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner[np.cumsum(inside)[: len(ids)] > 0], minlength=len(counts))


def quality_rules(docs: DataFrame, text_col: str = "text", bands: Sequence[tuple[int, float, float]] = tuple(BANDS), chunk: int = CHUNK,
                  level: int = LEVEL, bad_share: float = BAD_SHARE) -> DataFrame:
    """``docs`` with counts of each text, ``base_failed``, ``whole_ratio``, ``bad_chunk_share`` and ``kept``.

    Words are runs of anything but U+0020 and U+0009 to U+000D. ``word_chars`` has the code points in words, ``n_symbols`` the
    signs ``#*$%&|<>``, ``n_dup_lines`` the lines (between line feeds, with a word) equal to an earlier one, ``n_repeat_words``
    the words in windows of five words found twice or more. A text fails when it has under ten words or more than 20 % of them in
    such windows. Of the others one is kept when its zstandard ratio (bytes by compressed bytes) is inside the band for its
    length, and no more than ``bad_share`` of its bytes lie in chunks of ``chunk`` bytes that are outside the band for theirs.

    Every row, repeated ones too, is read whole and gives one row, without a shuffle; a task holds about ``TOGETHER`` bytes of
    texts, or one text, at a time. A null text counts as empty: all counts 0, ratio 0, failed and not kept. Columns named
    as result columns are replaced. An empty table gives an empty one.
    """
    kept = beside(docs, [name for name, _ in RESULT])
    rows = docs.select(*map(quoted, kept), quoted(text_col).cast("string").alias("_words_of"))
    bands = list(bands)

    def judge(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches, 4000, TOGETHER):
            texts = bytes_of(batch, "_words_of")
            words, ids, counts = numbered_words(texts)
            n_chars = np.array([len(t.translate(None, NO_CHARACTER)) for t in texts], np.int64)
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
            lines = np.array([repeated_lines(t) for t in texts], np.int64)
            again = repeated_words(ids, counts, WINDOW)
            failed = (counts < LEAST_WORDS) | (100 * again > REPEATED_PERCENT * counts)
            pressed = [compression(t, compressor, chunk, bands) for t in texts]
            ratio, share, inside = (np.array(x) for x in zip(*pressed, strict=True))
            good = ~failed & inside.astype(bool) & (share <= bad_share)
            values = [counts, n_chars, symbols, lines, again, failed, ratio.astype(float), share.astype(float), good]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, values)], names=[*kept, *[name for name, _ in RESULT]])

    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t in RESULT]]))
