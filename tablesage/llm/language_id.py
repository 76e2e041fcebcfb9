"""Language of texts: script ranges, scores per word, and Viterbi over the words with a penalty for switching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.llm.common import beside, quoted, slices, texts_of

#: First code points of ranges and the script of each.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
]
STARTS = np.array([start for start, _ in RANGES])
SCRIPTS = sorted({script for _, script in RANGES})
SCRIPT_OF = np.array([SCRIPTS.index(script) for _, script in RANGES])
#: Labelled rows that are learned from at most; buckets of the byte n-grams; n-gram lengths.
SAMPLE, BUCKETS, LENGTHS = 8_000, 1 << 16, (1, 2, 3, 4)
#: Cost in log units of changing the language between words; how far languages not seen in a word's script stand behind the last that is.
SWITCH, FOREIGN_SCRIPT = 12.0, 25.0
#: A script is a language's when so large a share of its words has it.
SCRIPT_SHARE = 0.01
#: Words a worker remembers before it starts anew, and bytes of text that advance together.
REMEMBERED, TOGETHER = 250_000, 5_000_000
UNDETERMINED = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram of each word (with a mark before and behind it), and the number of the word."""
    joined = ("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, np.uint8)
    number = np.cumsum(data == 2) - 1
    code = data.astype(np.uint64) + np.uint64(1)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(data) < n:
                break
            last = len(data) - n + 1
            value = np.full(last, n, np.uint64)
            for j in range(n):
                value = (value ^ code[j : j + last]) * _MIX[j]
                value ^= value >> np.uint64(29)
            same = number[:last] == number[n - 1 :]
            buckets.append((value[same] >> np.uint64(48)).astype(np.int64) % BUCKETS)
            owners.append(number[:last][same])
    return np.concatenate(buckets), np.concatenate(owners)


def script_numbers(words: Sequence[str]) -> np.ndarray:
    """The script of each word's first letter; -1 without a letter."""
    first = [next((ord(c) for c in w if c.isalpha()), -1) for w in words]
    points = np.array(first, np.int64)
    scripts = SCRIPT_OF[np.searchsorted(STARTS, np.maximum(points, 0), "right") - 1]
    return np.where(points < 0, -1, scripts)


class WordScores(dict):
    """Number of each word a worker has met, and its scores by language (row 0: no letter)."""

    def __init__(self, weights: np.ndarray, scripts: np.ndarray):
        super().__init__()
        self.weights, self.scripts = weights, scripts
        self.table, self.fresh = np.zeros((0, weights.shape[1]), np.float32), []
        self.letters = np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.table) + len(self.fresh)
        self.fresh.append(word)
        return number

    def learn(self) -> None:
        """Score the words that are new."""
        if not self.fresh:
            return
        buckets, owners = grams(self.fresh)
        script = script_numbers(self.fresh)
        known = self.scripts[script]
        known[~known.any(axis=1)] = True  # a script of no language speaks against none
        scores = np.full(known.shape, np.inf, np.float32)
        for k in range(known.shape[1]):  # a language is scored for the words in its scripts alone
            own = known[owners, k]
            scores[known[:, k], k] = np.bincount(owners[own], self.weights[buckets[own], k], len(self.fresh))[known[:, k]]
        if known.shape[1]:
            scores = np.where(known, scores, scores.min(1, keepdims=True) - np.float32(FOREIGN_SCRIPT))
        scores[script < 0] = 0
        self.table = np.concatenate([self.table, scores])
        self.letters = np.concatenate([self.letters, script >= 0])
        self.fresh = []


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: texts advance together, one word a step; ``scores`` has a row per word."""
    number = np.int8 if scores.shape[1] <= 127 else np.int32
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    back = np.zeros(scores.shape, number)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")  # texts longer than the step
    best = np.zeros((len(lengths), scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=number)
    for step in range(steps):
        n = active[step]
        at, now = starts[:n] + step, best[:n]
        if step:
            top = now.argmax(1)
            other = now[np.arange(n), top][:, None] - switch
            back[at] = np.where(now >= other, own, top[:, None].astype(number))
            now = np.maximum(now, other)
        best[:n] = now + scores[at]
    last = best.argmax(1).astype(np.int32)
    for step in range(steps - 1, -1, -1):
        n = active[step]
        at = starts[:n] + step
        labels[at] = last[:n]
        last[:n] = back[at, last[:n]] if step else last[:n]
    return labels


class LanguageModel:
    """Weights of n-gram buckets by language, and which scripts each language is written in."""

    def __init__(self, languages: Sequence[str], weights: np.ndarray, scripts: np.ndarray):
        self.languages, self.weights, self.scripts = list(languages), weights, scripts

    def transform(self, docs: DataFrame, text_col: str = "text", spans: bool = False) -> DataFrame:
        """``docs`` with ``lang_pred`` and ``score``, and with ``spans`` the labelled spans.

        ``lang_pred`` has most of the text by words' lengths; the score is its share. A text that is null or has no letter
        is "und" with score 0, and so is every text when nothing was learned. Spans are (lang, first word, words). Reads
        the text alone, row for row, without a shuffle; columns named as result columns are replaced.
        """
        extra = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
        if spans:
            extra.append(("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))))
        kept = beside(docs, [name for name, _ in extra])
        rows = docs.select(*[quoted(c) for c in kept])
        languages, weights, scripts = self.languages, self.weights, self.scripts
        span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

        def label(batches):
            known = WordScores(weights, scripts)
            for batch in slices(batches, 4000, TOGETHER * 8 // max(8, len(languages))):
                if len(known) >= REMEMBERED:
                    known = WordScores(weights, scripts)
                numbers, sizes, lengths = [], [], []
                for text in texts_of(batch, text_col):
                    words = words_of(text)
                    numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    sizes.append(np.fromiter(map(len, words), np.int32, len(words)))
                    lengths.append(len(words))
                known.learn()
                lengths = np.array(lengths, np.int64)
                starts = np.cumsum(lengths) - lengths
                number = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
                size = np.where(known.letters[number], np.concatenate(sizes), 0) if len(number) else np.zeros(0)
                labels = viterbi(known.table[number], starts, lengths) if languages else np.zeros(len(number), np.int32)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                share = np.zeros((len(lengths), max(1, len(languages))))
                for k in range(share.shape[1]):
                    share[:, k] = np.bincount(owner, np.where(labels == k, size, 0), len(lengths))
                total = share.sum(1)
                top = share.argmax(1)
                found = (total > 0) & bool(languages)
                score = np.where(found, share[np.arange(len(top)), top] / np.maximum(total, 1), 0.0)
                named = [languages[t] if ok else UNDETERMINED for t, ok in zip(top, found, strict=True)]
                columns = [*batch.columns, pa.array(named, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array([span_list(labels[a : a + n], languages) if ok else [] for a, n, ok in zip(starts, lengths, found, strict=True)], span_type))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[name for name, _ in extra]])

        return rows.mapInArrow(label, T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in extra]]))


def span_list(labels: np.ndarray, languages: Sequence[str]) -> list[dict]:
    """Runs of one label."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    bounds = [0, *cuts.tolist(), len(labels)]
    return [{"lang": languages[labels[a]], "first": a, "words": b - a} for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def fit_languages(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from at most ``sample`` rows with a language: those with the smallest hash of their text.

    Counting is done where the rows are; the driver gets at most ``BUCKETS`` numbers for each language. Rows with a null
    or empty text or a null language are left out; without any, the model knows no language.
    """
    labelled = docs.select(quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang")).where("text != '' AND lang IS NOT NULL")
    hashed = labelled.select(F.xxhash64("text", "lang").alias("h"))
    bound = hashed.distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    chosen = labelled.where(F.xxhash64("text", "lang") <= bound).dropDuplicates()

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                if words:
                    counts = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    counts[:BUCKETS] += np.bincount(grams(words)[0], minlength=BUCKETS)
                    scripts = script_numbers(words)
                    counts[BUCKETS:] += np.bincount(scripts[scripts >= 0], minlength=len(SCRIPTS))
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at), "n": pa.array(counts[at])})

    counted = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[counted["bucket"], counted["lang"].map(languages.index)] = counted["n"]
    smoothed = table[:BUCKETS] + 0.5
    weights = np.log(smoothed / smoothed.sum(0))
    weights -= weights.mean(1, keepdims=True)
    scripts = table[BUCKETS:] >= SCRIPT_SHARE * np.maximum(1, table[BUCKETS:].sum(0))
    return LanguageModel(languages, weights.astype(np.float32), scripts)
