"""Toxicity by a weighted lexicon that is matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.llm.common import beside, quoted, slices, texts_of

#: Letters of other scripts, and signs, that look like Latin letters.
LOOKALIKES = dict(zip("аеорсухікмнтвѕјԁԛԝαεικνορτυχ", "aeopcyxikmhtbsjdqwaeiknoptux", strict=True))
#: Digits and signs that stand for letters within words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | dict.fromkeys("​‌‍⁠­", ""))
#: Words that count before anything is learned, with their weight.
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown")
SEED_WEIGHT = 3.0
#: Phrases in which a listed word is meant otherwise.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "class clown", "clown fish", "clown nose", "sore loser board")
#: Labelled rows that are learned from at most, and entries of the lexicon.
SAMPLE, ENTRIES = 20_000, 2_000
#: Lengths of word beginnings that may be entries (besides whole words), marked by "*".
STEMS = (4, 5, 6, 7)


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def features(text: str) -> set[str]:
    """Whole words and beginnings of words of a folded text."""
    words = {"".join(filter(str.isalpha, w)) for w in set(fold(text).split())}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Weighted entries ("word" or "stem*") and exceptions as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for entry, weight in weights.items():
            entries.setdefault(entry.rstrip("*"), []).append((weight, not entry.endswith("*")))
        for phrase in map(fold, exceptions):
            entries.setdefault(phrase, []).append((None, True))
        for text, kinds in entries.items():
            self.automaton.add_word(text, (len(text), kinds))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def evidence(self, text: str) -> float:
        """Weights of the matched words, each counted once per place by its heaviest entry, over the log of the length."""
        folded = fold(text)
        if self.empty or not folded:
            return 0.0
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, kinds) in self.automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
            for weight, needs_whole in kinds:
                if whole or not needs_whole:
                    if weight is None:
                        excused.append((start, end))
                    else:
                        hits[start] = max(weight, hits.get(start, -math.inf))
        total = sum(w for at, w in hits.items() if not any(a <= at <= b for a, b in excused))
        return total / math.log2(2 + len(folded) / 6)


def _weights(docs: DataFrame, sample: DataFrame, entries: int) -> dict[str, float]:
    """The entries that labels speak for: share among toxic texts against others, where chance can't explain it."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                for feature in features(text):
                    seen.setdefault(feature, [0, 0])[toxic] += 1
        if seen:
            names, pairs = zip(*seen.items(), strict=True)
            no, yes = zip(*pairs, strict=True)
            yield pa.record_batch({"entry": pa.array(names), "yes": pa.array(yes, pa.int64()), "no": pa.array(no, pa.int64())})

    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    yes, no = totals.get(1, 0), totals.get(0, 0)
    if not yes or not no:
        return {}
    share, n = yes / (yes + no), F.col("yes") + F.col("no")
    counted = docs.select("text", "toxic").mapInArrow(count, "entry string, yes long, no long").groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    p = F.col("yes") / n
    surprise = F.col("yes") * F.log(p / share) + F.when(F.col("no") > 0, F.col("no") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    weight = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("no") + 0.5) / (no + 1))
    chosen = (
        counted.where((F.col("yes") > 0) & (p > 0.5) & (F.length("entry") > 2))
        .select("entry", weight.alias("weight"), surprise.alias("surprise"))
        .where(F.col("surprise") > math.log(100 * max(yes + no, 100)))
        .orderBy(F.desc("surprise"), "entry").limit(entries)
    )
    return {r.entry: r.weight for r in chosen.collect()}


class ToxicityModel:
    """A lexicon and the line that turns its evidence into a probability."""

    def __init__(self, weights: dict[str, float], slope: float, base: float, exceptions: Sequence[str] = EXCEPTIONS):
        self.weights, self.slope, self.base, self.exceptions = weights, slope, base, tuple(exceptions)

    def transform(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

        Reads the text alone. A null or empty text has no evidence, so it gets the score of that. Row for row, without a
        shuffle; columns of ``docs`` named as result columns are replaced.
        """
        kept = beside(docs, ["score", "predicted"])
        rows = docs.select(*[quoted(c) for c in kept])
        weights, slope, base, exceptions = self.weights, self.slope, self.base, self.exceptions

        def score(batches):
            lexicon = Lexicon(weights, exceptions)
            for batch in slices(batches):
                evidence = np.array([lexicon.evidence(t) for t in texts_of(batch, text_col)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-(slope * evidence + base))))], names=[*kept, "score"])

        schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
        return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, exceptions: Sequence[str] = EXCEPTIONS) -> ToxicityModel:
    """Learn from at most ``sample`` labelled rows: those with the smallest hash of their doc_id.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; null rows are left out). The sample's size bounds
    what is broadcast and what the driver gets: the chosen ids, one evidence for each, and the lexicon. Without both
    labels the seeds alone decide.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas().astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    weights = dict.fromkeys(map(fold, SEEDS), SEED_WEIGHT) | _weights(rows, chosen, entries)

    def measure(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in slices(batches):
            evidence = [lexicon.evidence(t) for t in texts_of(batch)]
            yield pa.record_batch({"evidence": pa.array(evidence, pa.float64()), "toxic": batch.column("toxic")})

    seen = rows.select("text", "toxic").mapInArrow(measure, "evidence double, toxic int").limit(sample).toPandas()
    slope, base = _line(seen["evidence"].to_numpy(), seen["toxic"].to_numpy())
    return ToxicityModel(weights, slope, base, exceptions)


def _line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Logistic regression on one number by Newton's steps; a falling line is no use, so the slope is positive."""
    if not len(x) or not (y == 1).any() or not (y == 0).any():
        return 4.0, -2.0
    design, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (4.0, -2.0)
