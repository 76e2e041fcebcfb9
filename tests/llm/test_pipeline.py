"""The pipeline on a small corpus: each stage's decisions take effect, and clean documents stay."""

from __future__ import annotations

import corpus_pipeline
from tablesage.llm.common import materialize, table


def test_stages(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").limit(40).collect()
    base = " ".join(f"word{i} other{i}" for i in range(60))
    extra = [
        (9001, "You are a stupid worthless idiot, pathetic scum, you moron and loser", "en", "s", 1), (9002, base, "en", "s", 1), (9003, base.upper(), "en", "s", 1),
        (9004, base.replace("word30", "changed"), "en", "s", 1), (9005, "my password=hunter2222 is here", "en", "s", 1), (9006, None, None, None, None), (9007, "", "en", "s", 0),
    ]
    docs = spark.createDataFrame([tuple(r) for r in plain] + extra, "doc_id long, text string, lang string, source string, n_chars long")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        assert name == "packing" or docs.columns == columns
    assert 9001 not in seen["toxicity"] and {9002, 9005, 9006} <= set(seen["toxicity"])
    assert 9002 not in seen["exact_dedup"] and {9003, 9004} <= set(seen["exact_dedup"])
    assert sum(i in seen["exact_dedup"] for i in (9006, 9007)) == 1
    assert 9003 in seen["ngram_jaccard"] and 9004 not in seen["ngram_jaccard"]
    assert seen["secrets"][9005].text == "my [SECRET] is here" and seen["secrets"][9005].n_chars == 19
    assert set(seen["secrets"]) == set(seen["ngram_jaccard"])
    assert {r.doc_id for r in seen["packing"]} == set(seen["secrets"])


def test_names_and_empty(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "secrets", "packing"]
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_clashing_columns_and_repeated_ids(spark, sf_dir):
    """Columns named as results stay as they are, and a row goes for its own text, not for one that shares its id."""
    base = " ".join(f"word{i} other{i}" for i in range(60))
    clean = " ".join(f"unrelated{i} thing{i}" for i in range(60))
    near = base.replace("word30", "changed")
    rows = [(1, base), (2, near), (2, clean), (None, near.replace("word40", "again")), (None, "a text of its own"), (3, "password=hunter2222 it is")]
    docs = spark.createDataFrame([(*r, f"s{i}", f"k{i}", [f"x{i}"], i, i, i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, score string, kept string, secret_spans array<string>, predicted int, keep_id int, group_size int")
    own = {r.score: tuple(r)[2:] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "clashes")
    found = docs.collect()
    assert sorted(r.score for r in found) == ["s0", "s2", "s4", "s5"]
    assert all(tuple(r)[2:] == own[r.score] for r in found)
    assert {r.score: r.text for r in found}["s5"] == "[SECRET] it is"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 4
