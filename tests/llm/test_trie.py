"""The trie of conversations: against plain code, with distributed rounds, on odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablesage.llm.prefix_trie import prefix_trie, roll_up_component
from tablesage.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(turns, members):
    """{(conv_id, depth): the other columns} of conversations {id: [(role, text)]}."""
    nodes = defaultdict(list)
    for conv in sorted(members):
        path = turns.get(conv, [])
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(conv)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [sums[c] for c in children[path]]
        saved = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        sums[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = {}
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in convs if len(turns.get(c, [])) == len(path))
        parent = nodes[path[:-1]][0] if path else None
        out[(convs[0], len(path))] = (parent, len(convs), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def ordered(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def rows_of(found):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect()}


def conversations(draw, n):
    rows = []
    for conv in draw.sample(range(-50, 10_000), n):
        text = "".join(draw.choices("ab", weights=[5, 1], k=draw.choice([0, 1, 3, 6, 30])))
        rows += [(conv, i, "user", c) for i, c in enumerate(text)]
    rows += [(7, None, None, None), (7, None, "b", "ü🙂"), (7, 3, "b", None), (7, 3, "a", "x"), (7, 3, "a", "x"), (None, 1, "a", "b")]
    rows += [(20_000, i, "user", "deep" if i > 5 else "a") for i in range(150)]
    return rows


@pytest.mark.parametrize("small,seed", [(3, 1), (40, 2), (10**6, 3)])
def test_trie_against_plain_code(spark, small, seed):
    rows = conversations(random.Random(seed), 60)
    turnless = [30_000, 30_001]
    turns = ordered(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", k1 string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*turnless, *turns, 7]], "conv_id long")
    assert rows_of(prefix_trie(df, members=ids, small=small)) == plain_trie(turns, {*turns, *turnless})
    if seed == 2:
        assert rows_of(prefix_trie(df, small=small)) == plain_trie(turns, set(turns))


def test_trie_without_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = prefix_trie(spark.createDataFrame([], SCHEMA), members=spark.createDataFrame([(5,)], "conv_id long"))
    assert rows_of(alone) == plain_trie({}, {5})


def test_rollup_of_one_component():
    draw = random.Random(6)
    for n in [1, 2, 3, 50, 400]:
        for shape in ("path", "star", "random"):
            parents = [0] + [{"path": i - 1, "star": 0, "random": draw.randrange(i)}[shape] for i in range(1, n)]
            weight, values = [draw.randint(1, 5) for _ in range(n)], [(draw.randint(0, 9), 1) for _ in range(n)]
            sums = [list(v) for v in values]
            below = list(weight)
            for i in range(n - 1, 0, -1):
                below[parents[i]] += below[i]
                sums[parents[i]] = [a + b for a, b in zip(sums[parents[i]], sums[i])]
            assert roll_up_component(parents, below, values) == sums


def test_query_against_plain_code(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = ordered(rows)
    turns = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, sf_dir)) == plain_trie(turns, set(own))
