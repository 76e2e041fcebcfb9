"""Exact, n-gram and vector duplicates against brute force, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesage.llm import embedding_dedup
from tablesage.llm.components import components
from tablesage.llm.embedding_dedup import near_vectors
from tablesage.llm.exact_dedup import exact_dedup
from tablesage.llm.ngram_join import ngram_jaccard
from tablesage.llm.shingles import shingle_sets


class Groups:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall("[^ \t-\r]+", lowered(text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_copies(seed, groups=25, copies=(1, 2, 5, 30)):
    draw, texts = random.Random(seed), []
    for _ in range(groups):
        base = [draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.choice([1, 3, 5, 8, 20, 60]))]
        for _ in range(draw.choice(copies)):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice("klmno")
            texts.append(" ".join(words[: draw.randint(1, len(words))] if draw.random() < 0.3 else words))
    return texts + [None, "", " \n\t", "ÉTÉ a b", "été a b"]


@pytest.mark.parametrize("first,growth", [(2, 2), (64, 16)])
def test_exact_dedup_against_brute_force(spark, first, growth):
    draw = random.Random(1)
    texts = ["".join(draw.choices("aAbé ", k=draw.randint(0, 9))) for _ in range(300)] + ["x" * 5000] * 3 + ["x" * 4999 + "Y", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for i, text in enumerate(texts):
        groups[lowered(text)].append(i)
    expected = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep=["doc_id"], first=first, growth=growth).collect()}
    assert got == expected
    whole = exact_dedup(docs, first=first, growth=growth)
    assert whole.columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    assert {r.doc_id: r.text for r in whole.collect()} == dict(enumerate(texts))


def test_exact_dedup_ties_nulls_clashes_and_empty(spark):
    rows = [(7, "same", 1, "old"), (7, "SAME", 2, "old"), (None, "same", 3, "old"), (None, "alone", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int, Kept string")
    got = exact_dedup(docs).collect()
    assert [r.asDict()["keep_id"] for r in sorted(got, key=lambda r: r.extra)] == [7, 7, 7, None]
    assert sum(r.kept for r in got) == 2 and [r.kept for r in got if r.extra == 4] == [True]
    assert exact_dedup(docs).columns == ["doc_id", "text", "extra", "keep_id", "group_size", "kept"]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_shingle_sets_equal_when_texts_sets_are():
    draw = random.Random(2)
    texts = ["".join(draw.choices(["a", "B", "é", "\t", "\n", " ", "  ", "xy", "\x0b", "\xa0", "Z"], k=draw.randint(0, 40))) for _ in range(800)]
    hashes, counts = shingle_sets(texts)
    known = {}
    for text, part in zip(texts, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
        assert known.setdefault(shingles(text), frozenset(part.tolist())) == frozenset(part.tolist())
        assert len(part) == len(shingles(text))
    assert len(set(known.values())) == len(known)
    assert [len(x) for x in shingle_sets([])] == [0, 0]


@pytest.mark.parametrize("rounds", [(1, 8), ()])
def test_ngram_jaccard_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr("tablesage.llm.ngram_join.ROUNDS", rounds)
    for name, value in (("PART", 4), ("BLOCK_ROWS", 3), ("BLOCK_COLUMNS", 7)):
        monkeypatch.setattr(f"tablesage.llm.ngram_join.{name}", value)
    texts = near_copies(3)
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    sets = {i + 10: shingles(t) for i, t in enumerate(texts)}
    groups = Groups(sets)
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            groups.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(docs).collect()}
    assert got == {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_ngram_jaccard_repeats_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "A B C D E F"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in ngram_jaccard(docs).collect())
    assert got == [(False, 3, 2, 3), (False, 3, 2, 3), (False, 5, 2, 3), (True, 0, 0, -1), (True, 0, 2, 3)]
    assert ngram_jaccard(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(i + 1000, i + 1001) for i in range(60)] + [(None, 3), (5, 5)]
    groups = Groups(range(2000))
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: groups.find(x) for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cell,home,visitors", [(16, 8, 32), (1024, 1024, 4096)])
def test_near_vectors_against_brute_force(spark, monkeypatch, cell, home, visitors):
    for name, value in (("CELL", cell), ("HOME", home), ("VISITORS", visitors)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(1)
    base, rows = rng.standard_normal((40, 8)), []
    for i in range(400):
        vector = (base[rng.integers(40)] + rng.standard_normal(8) * rng.choice([0, 0.05, 0.2, 0.6])) * rng.choice([1, 3])
        rows.append((i + 5, [float(np.float32(x)) for x in vector], int(rng.integers(2))))
    odd = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, None] + [0.0] * 6, [], [1.0, 2.0]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(2100, rows[0][1], None), (2101, rows[0][1], rows[0][2])]
    groups, links = Groups(r[0] for r in rows), dict.fromkeys((r[0] for r in rows), 0)
    for a, b in itertools.combinations([r for r in rows[:400] + rows[-1:]], 2):
        x, y = np.array(a[1]), np.array(b[1])
        if a[2] == b[2] and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links[a[0]] += 1
            links[b[0]] += 1
            groups.join(a[0], b[0])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    assert got == {i: (links[i], groups.find(i), groups.find(i) == i) for i in links}
    assert near_vectors(frame.limit(0)).count() == 0


def test_lowest_estimate_is_a_bound():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * 0.024
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = embedding_dedup.rotation(64)
    signs, factors = embedding_dedup.codes(x @ turn)
    estimate = np.diag(embedding_dedup.estimates(signs, factors, y @ turn))
    cosine, near = (x * y).sum(1), (x * y).sum(1) >= 0.98
    assert near.any() and (estimate[near] >= embedding_dedup.lowest_estimate(factors, 0.98)[near] - embedding_dedup.SLACK).all()
    assert abs((estimate - cosine).mean()) < 0.01  # unbiased


def test_near_vectors_of_one_id_in_two_labels(spark):
    """Rows have the links of their own vector and label; doubles are compared as doubles."""
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, "a", same), (2, "a", same), (1, "b", other), (3, "b", other), (1, "a", other), (7, "c", [1.0, 1e-9]), (8, "c", [1.0, 1.1e-9])]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [
        (1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (8, 1, 7, False),
    ]
    edge = 0.98
    x, y = [1.0, 0.0], [edge, float(np.sqrt(1 - edge**2)) * (1 + 1e-9)]
    pair = spark.createDataFrame([(1, "a", x), (2, "a", y)], "vec_id long, label string, embedding array<double>")
    cosine = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
    assert [r.n_links for r in near_vectors(pair).collect()] == [int(cosine >= edge)] * 2
