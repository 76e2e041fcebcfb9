"""Periodic runs of words, found on a Re-Pair grammar of the texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesage.llm.common import beside, quoted, slices
from tablesage.llm.shingles import mix
from tablesage.llm.word_windows import bytes_of, numbered_words, repeated, window_hashes

#: A run has at least so many words and so many periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Bytes of text whose grammar is made together, and comparisons made at a time.
TOGETHER, AT_ONCE = 4_000_000, 4_000_000
#: Two primes below 2^31.
PRIMES = (2**31 - 1, 2**31 - 19)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = [("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]


@dataclass
class Grammar:
    """Nonterminals of segments of text: where each first stands, its length, the length of its left part, and all places."""

    first: np.ndarray
    size: np.ndarray
    left: np.ndarray
    places: np.ndarray  # of all nonterminals, by nonterminal
    starts: np.ndarray  # where each one's places begin; one more entry than nonterminals


def places_of_pairs(weight: np.ndarray) -> np.ndarray:
    """Places whose weight tops that of both neighbours; of equal neighbours every other one, from the left."""
    new = np.ones(len(weight), bool)
    new[1:] = weight[1:] != weight[:-1]
    begin = np.flatnonzero(new)
    level = weight[begin]
    top = level > 0
    top[1:] &= level[1:] > level[:-1]
    top[:-1] &= level[:-1] > level[1:]
    plateau = np.cumsum(new) - 1
    return np.flatnonzero(top[plateau] & ((np.arange(len(weight)) - begin[plateau]) % 2 == 0))


def repair(words: np.ndarray, lengths: np.ndarray) -> Grammar:
    """Re-Pair grammar of segments (``lengths`` words each, one after the other in ``words``), all segments sharing it.

    A round counts the neighbouring pairs and replaces those more frequent than the pairs they overlap with (frequencies by
    powers of two, ties by a hash), so that many pairs are replaced at once. When no pair occurs twice, neighbours are
    paired up until each segment is one nonterminal; these have one place each. A replaced pair is an occurrence of its
    nonterminal in the text, so its places are those of the whole derivation.
    """
    symbol, place = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
    width = np.ones(len(words), np.int64)
    last = np.zeros(len(words), bool)
    last[np.cumsum(lengths) - 1] = True
    maybe = ~last  # pairs that may occur twice
    next_symbol = first_symbol = int(words.max()) + 1 if len(words) else 0
    known_keys, known_names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = []  # symbol, place, size, size of the left part of each replaced pair

    def replace(chosen: np.ndarray, names: np.ndarray) -> None:
        nonlocal symbol, place, width, last, maybe
        found.append((names, place[chosen], width[chosen] + width[chosen + 1], width[chosen].copy()))
        symbol[chosen] = names
        width[chosen] += width[chosen + 1]
        last[chosen] = last[chosen + 1]
        maybe[chosen] = True
        maybe[np.maximum(chosen - 1, 0)] = True
        stays = np.ones(len(symbol), bool)
        stays[chosen + 1] = False
        symbol, place, width, last, maybe = symbol[stays], place[stays], width[stays], last[stays], maybe[stays]
        maybe &= ~last

    while True:
        asked = np.flatnonzero(maybe)
        keys, which, counts = np.unique((symbol[asked] << 32) | symbol[asked + 1], return_inverse=True, return_counts=True)
        twice = counts[which] >= 2
        maybe[asked[~twice]] = False
        if not twice.any():
            break
        weights = (np.log2(counts).astype(np.uint64) << np.uint64(57)) | (mix(keys.astype(np.uint64)) >> np.uint64(7)) | np.uint64(1)
        weight = np.zeros(len(symbol), np.uint64)
        weight[asked[twice]] = weights[which[twice]]
        chosen = places_of_pairs(weight)
        pairs = (symbol[chosen] << 32) | symbol[chosen + 1]
        at = np.searchsorted(known_keys, pairs)
        new = (at == len(known_keys)) | (known_keys[np.minimum(at, len(known_keys) - 1)] != pairs) if len(known_keys) else np.ones(len(pairs), bool)
        fresh = np.unique(pairs[new])
        merged = np.concatenate([known_keys, fresh])
        order = np.argsort(merged, kind="stable")
        known_keys = merged[order]
        known_names = np.concatenate([known_names, next_symbol + np.arange(len(fresh))])[order]
        next_symbol += len(fresh)
        replace(chosen, known_names[np.searchsorted(known_keys, pairs)])

    while not last.all():
        begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        offset = np.arange(len(symbol)) - np.repeat(begin, np.diff(np.append(begin, len(symbol))))
        chosen = np.flatnonzero((offset % 2 == 0) & ~last)
        replace(chosen, next_symbol + np.arange(len(chosen)))
        next_symbol += len(chosen)

    if not found:
        none = np.zeros(0, np.int64)
        return Grammar(none, none, none, none, np.zeros(1, np.int64))
    names, places, sizes, lefts = (np.concatenate(parts) for parts in zip(*found, strict=True))
    order = np.lexsort((places, names))
    names, places, sizes, lefts = names[order] - first_symbol, places[order], sizes[order], lefts[order]
    starts = np.searchsorted(names, np.arange(next_symbol - first_symbol + 1))
    return Grammar(places[starts[:-1]], sizes[starts[:-1]], lefts[starts[:-1]], places, starts)


class Extensions:
    """How far two places of an array of words agree, to the right or to the left, by hashes modulo two primes."""

    def __init__(self, words: np.ndarray, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.sums, self.powers = [], []
        for prime in PRIMES:
            p = np.uint64(prime)
            base = np.uint64(draw.integers(2**20, prime - 1))
            values = draw.integers(1, prime, int(words.max()) + 1 if len(words) else 1).astype(np.uint64)[words]
            power, factor = np.ones(1, np.uint64), base
            while len(power) <= len(words):
                power, factor = np.concatenate([power, power * factor % p]), factor * factor % p
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(values * power[: len(words)] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(power)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``a`` are those from ``b`` (``a`` < ``b``)."""
        equal = np.ones(len(a), bool)
        for prime, sums, power in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            one, two = (sums[a + length] + p - sums[a]) % p, (sums[b + length] + p - sums[b]) % p
            equal &= one * power[b - a] % p == two
        return equal

    def reach(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, backward: bool) -> np.ndarray:
        """The largest number of words, up to ``limit``, that agree from ``a`` and ``b`` on, or with ``backward`` before them."""
        got = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(limit.max()).bit_length() if len(limit) else 0)):
            tried = np.flatnonzero(got + (1 << bit) <= limit)
            length = got[tried] + (1 << bit)
            shift = length if backward else 0
            got[tried] += self.same(a[tried] - shift, b[tried] - shift, length).astype(np.int64) << bit
        return got


def runs_across(words: np.ndarray, grammar: Grammar, extensions: Extensions, min_length: int, min_periods: int) -> np.ndarray:
    """Rows (nonterminal, start within it, length, period): runs that cross the boundary of its parts, as far as it goes.

    Such a run has half its length on one side of the boundary, where the words next to it repeat one period further on; only
    periods for which these few words do are looked at.
    """
    near = min(-(-max(min_length, min_periods * q) // 2) - q for q in range(1, min_length + 1))
    _, hashes = window_hashes(words, np.array([len(words)]), near)
    large = np.flatnonzero(grammar.size >= min_length)
    periods = grammar.size[large] // min_periods
    bounds = np.cumsum(periods)
    found = [np.zeros((0, 4), np.int64)]
    at = 0
    while at < len(large):
        upto = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + AT_ONCE, "right")))
        part, counts = large[at:upto], periods[at:upto]
        at = upto
        rule = np.repeat(part, counts)
        period = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        low, middle = grammar.first[rule], (grammar.first + grammar.left)[rule]
        high = low + grammar.size[rule]
        for forward in (True, False):
            here = middle if forward else middle - near
            there = here + period if forward else here - period
            inside = (there + near <= high) if forward else (there >= low)
            inside &= (here + near <= high) & (here >= low)
            inside[inside] = hashes[here[inside]] == hashes[there[inside]]
            r, q, lo, mid, hi = (x[inside] for x in (rule, period, low, middle, high))
            a, b = (mid, mid + q) if forward else (mid - q, mid)  # the two places that agree
            start = a - extensions.reach(a, b, a - lo, True)
            end = b + extensions.reach(a, b, hi - b, False)
            good = (end - start >= np.maximum(min_length, min_periods * q)) & (start < mid) & (end > mid)
            found.append(np.stack([r, start - lo, end - start, q], 1)[good])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[smallest]


def runs_of(ids: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period: the runs of texts with ``counts`` words each.

    In a run every window of ``min_length // min_periods`` words (2 at least) occurs again one period on or back, so only stretches of
    windows that occur twice in their text are compressed; no run leaves its stretch. Runs found across the boundary of a
    nonterminal hold at each of its places; of intervals with one period the maximal ones stay, and of periods of one interval
    the smallest. The words of each run are compared in the end; should hashes have misled, all is done again with others.
    """
    if min_periods < 3 or min_length < min_periods:
        raise ValueError("runs need three periods or more, and a word for each")
    width = max(2, min_length // min_periods)
    starts, hashes = window_hashes(ids, counts, width)
    again = np.zeros(len(ids) + 1, bool)
    again[starts[repeated(hashes)]] = True
    owner = np.repeat(np.arange(len(counts)), counts)
    edge = np.diff(again.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the last words of a text start no window, so a stretch never goes on into the next text
    long = end - begin + width - 1 >= min_length
    begin, lengths = begin[long], (end - begin + width - 1)[long]
    if not len(begin):
        return np.zeros((0, 4), np.int64)
    offsets = np.cumsum(lengths) - lengths
    source = np.repeat(begin - offsets, lengths) + np.arange(int(lengths.sum()))  # place in the texts of each compressed word
    words = np.unique(ids[source], return_inverse=True)[1].astype(np.int64)
    grammar = repair(words, lengths)
    seed = 0
    while True:
        rows = runs_across(words, grammar, Extensions(words, seed), min_length, min_periods)
        times = np.diff(grammar.starts)[rows[:, 0]]
        which = np.repeat(np.arange(len(rows)), times)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        start = source[grammar.places[grammar.starts[rows[which, 0]] + nth] + rows[which, 1]]
        length, period = rows[which, 2], rows[which, 3]
        text = owner[start]
        # of intervals of one text and period, those inside another go
        order = np.lexsort((-length, start, period, text))
        text, start, length, period = text[order], start[order], length[order], period[order]
        group = np.cumsum(np.concatenate([[0], (np.diff(text) != 0) | (np.diff(period) != 0)])) if len(text) else np.zeros(0, np.int64)
        ends = start + length + group * (len(ids) + 1)
        reach = np.maximum.accumulate(ends) if len(ends) else ends
        stays = np.ones(len(ends), bool)
        stays[1:] = ends[1:] > reach[:-1]
        text, start, length, period = text[stays], start[stays], length[stays], period[stays]
        order = np.lexsort((period, length, start, text))
        text, start, length, period = text[order], start[order], length[order], period[order]
        smallest = np.ones(len(text), bool)
        smallest[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
        text, start, length, period = text[smallest], start[smallest], length[smallest], period[smallest]
        if all(np.array_equal(ids[s : s + n - q], ids[s + q : s + n]) for s, n, q in zip(start, length, period, strict=True)):
            break
        seed += 1
    start = start - (np.cumsum(counts) - counts)[text]
    order = np.lexsort((period, start, text))
    return np.stack([text, start, length, period], 1)[order]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words that no run repeats.

    Words are runs of anything but U+0020 and U+0009 to U+000D, compared as they are and numbered from 0. A run is a stretch
    of words with smallest period q, at least ``min_length`` words and ``min_periods`` periods long, that no neighbouring word
    extends. ``collapsed`` has the words that lie in no run beyond its first period, joined by one space.

    Texts are read whole, row for row, without a shuffle; a task holds about ``TOGETHER`` bytes of them, or one text, at
    a time. A null text counts as empty; texts without words have no runs and collapse to the empty string. Every row,
    repeated ones too, gives one row; columns named as result columns are replaced. An empty table gives an empty one.
    """
    kept = beside(docs, [name for name, _ in RESULT])
    rows = docs.select(*map(quoted, kept), quoted(text_col).cast("string").alias("_words_of"))
    run_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))

    def find(batches):
        for batch in slices(batches, 4000, TOGETHER):
            words, ids, counts = numbered_words(bytes_of(batch, "_words_of"))
            found = runs_of(ids, counts, min_length, min_periods)
            per_text = np.bincount(found[:, 0], minlength=len(counts))
            bounds = np.concatenate([[0], np.cumsum(per_text)])
            dropped = np.zeros(len(ids) + 1, np.int64)
            first = (np.cumsum(counts) - counts)[found[:, 0]] + found[:, 1]
            np.add.at(dropped, first + found[:, 3], 1)
            np.add.at(dropped, first + found[:, 2], -1)
            stays = np.cumsum(dropped)[:-1] == 0
            collapsed, at = [], 0
            for own, n in zip(words, per_text.tolist(), strict=True):
                if n:
                    own = [w for w, ok in zip(own, stays[at : at + len(own)].tolist(), strict=True) if ok]
                collapsed.append(b" ".join(own))
                at += len(words[len(collapsed) - 1])
            spans = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(run_type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans).cast(run_type)
            columns = [*batch.columns[:-1], lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[name for name, _ in RESULT]])

    return rows.mapInArrow(find, T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t in RESULT]]))
