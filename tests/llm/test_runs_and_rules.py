"""Periodic runs and quality rules: against brute force, on odd texts, and the queries against plain code over whole documents."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from tablesage.llm.common import table
from tablesage.llm.periodic_runs import Extensions, periodic_runs, repair, runs_of
from tablesage.llm.quality_rules import BAD_SHARE, BANDS, CHUNK, COUNTS, quality_rules
from tablesage.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \t\n", "a", "a b " * 40, "é\x1cf 🙂 \xa0x " * 30, "x " * 5000, "\n".join(["same line here"] * 30), "w\x0b" * 24, "q" * 40_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=24, periods=3):
    """(start, length, period) of every run, period by period."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def some_words(draw):
    few, words = draw.choice([1, 2, 2, 3, 50]), []
    for _ in range(draw.randint(0, 6)):
        kind = draw.random()
        if kind < 0.4:
            part = [draw.randrange(few) for _ in range(draw.randint(1, 12))]
            words += (part * draw.randint(1, 9))[: draw.randint(1, 80)]
        elif kind < 0.5:
            words += [bin(i).count("1") % 2 for i in range(draw.randint(1, 64))]
        elif kind < 0.6 and words:
            words += words[: draw.randint(1, len(words))] * draw.randint(1, 3)
        else:
            words += [draw.randrange(few) for _ in range(draw.randint(0, 30))]
    return words


def test_runs_against_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        least, periods = draw.choice([(24, 3), (6, 3), (3, 3), (12, 4), (8, 3), (25, 3)])
        texts = [some_words(draw) for _ in range(draw.randint(1, 5))]
        found = runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least, periods)
        for i, words in enumerate(texts):
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == plain_runs(words, least, periods), (least, periods, words)


def test_grammar_derives_the_text():
    """Every place of a nonterminal has its words, and each segment is one nonterminal in the end."""
    draw = random.Random(4)
    for _ in range(50):
        segments = [s for s in (some_words(draw) for _ in range(3)) if len(s) > 1] or [[0, 0]]
        words, lengths = np.array(sum(segments, []), np.int64), np.array([len(s) for s in segments])
        grammar = repair(words, lengths)
        for k in range(len(grammar.size)):
            places = grammar.places[grammar.starts[k] : grammar.starts[k + 1]]
            own = {tuple(words[p : p + grammar.size[k]]) for p in places.tolist()}
            assert len(own) == 1 and 0 < grammar.left[k] < grammar.size[k]
        roots = {(int(p), int(grammar.size[k])) for k in range(len(grammar.size)) for p in grammar.places[grammar.starts[k] : grammar.starts[k + 1]]}
        assert set(zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist())) <= roots


def test_extensions():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
    reach = Extensions(words, 0).reach(np.array([0, 6]), np.array([3, 8]), np.array([5, 1]), False)
    assert reach.tolist() == [5, 0]
    assert Extensions(words, 0).reach(np.array([5]), np.array([8]), np.array([5]), True).tolist() == [5]


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, t, "mine", "too") for t in ODD] + [(1, "a b " * 40, "mine", "too")]
    found = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, other string").repartition(2)).collect()
    assert len(found) == len(rows) and found[0].other == "too"
    wanted = Counter()
    for _, text, _, _ in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        wanted[(tuple(runs), collapsed(words, runs))] += 1
    assert Counter((tuple(tuple(x) for x in r.runs), r.collapsed) for r in found) == wanted
    assert periodic_runs(spark.createDataFrame([], "text string")).count() == 0


def rebuilt_words(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd = spark.createDataFrame([(70_000 + i, t) for i in range(12) for t in [ODD[i % len(ODD)]]], "doc_id long, text string")
    table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_periodic_runs_query(spark, odd_dir):
    found = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, odd_dir).collect()}
    docs = table(spark, odd_dir, "documents").collect()
    assert len(found) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = rebuilt_words(doc_id, text)
        runs = plain_runs(words) if len(words) < 3000 else None
        got = found[doc_id]
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert got.collapsed_sha256 == sha(collapsed(words, runs))
        with_runs += bool(runs)
    assert with_runs >= 10


def plain_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, repeats = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    counts = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(again)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)

    def inside(data):
        low, high = [(b, c) for a, b, c in BANDS if a <= len(data)][-1]
        return low <= len(data) / len(zstandard.ZstdCompressor(level=3).compress(data)) <= high

    data = (text or "").encode()
    bad = sum(len(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK) if not inside(data[i : i + CHUNK]))
    return [*counts, failed, not failed and inside(data) and bad <= BAD_SHARE * len(data)]


def test_quality_rules_against_plain_counts(spark, odd_dir):
    found = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, odd_dir).collect()}
    for doc_id, text in table(spark, odd_dir, "documents").collect():
        assert [found[doc_id][c] for c in (*COUNTS, "base_failed", "kept")] == plain_rules(text), doc_id


def test_quality_rules_reject_what_compresses_too_well_or_not_at_all(spark):
    draw = random.Random(5)
    prose = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) + draw.choice(["", ",", "."]) for _ in range(900))
    noise = " ".join("".join(draw.choices([chr(c) for c in range(33, 127)], k=12)) for _ in range(900))
    lists = "\n".join(f"item-{i} on the list number-{i} call us now" for i in range(300))
    half = prose[:6000] + " " + " ".join(f"{i}-words of the same sort" for i in range(600))
    rows = [("prose", prose), ("noise", noise), ("lists", lists), ("half", half), ("none", None), ("twice", prose), ("twice", prose)]
    found = quality_rules(spark.createDataFrame([(n, t, "mine") for n, t in rows], "name string, text string, kept string")).collect()
    assert sorted((r.name, r.kept) for r in found) == [
        ("half", False), ("lists", False), ("noise", False), ("none", False), ("prose", True), ("twice", True), ("twice", True),
    ]
    assert not any(r.base_failed for r in found if r.name in ("noise", "lists", "half"))
    assert quality_rules(spark.createDataFrame([], "text string")).count() == 0
