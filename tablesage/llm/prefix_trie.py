"""Trie of conversations by their first turns, rolled up by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.llm.common import materialize, quoted
from tablesage.operators.numbering import Along, numbered

#: Turns of one conversation that are handled together; parts into which the children of a node are dealt.
CHUNK, SALTS = 1024, 16
#: Turns (of all members) below the top of a component that one task splits further by itself.
SMALL = 4096
#: What is added up over subtrees.
TOTALS = ["n_leaves", "saved_tokens"]
KEY, PARENT, TOP = ["k1", "k2"], ["p1", "p2"], ["t1", "t2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``d``, the place from 1: by turn, null first, ties by role and text."""
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return numbered(turns, ["conv_id"], [Along(chunk)], order, "d", start=1)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, chars, turns, k1, k2, p1, p2) for each turn: fingerprints of the first d and the first d - 1 turns.

    A fingerprint is the exclusive or of a hash of each turn with its place, 128 bits in all. Conversations are cut into
    pieces of ``CHUNK`` turns; the pieces' totals are carried on, so that a long conversation is no single task's.
    """
    digests = [F.xxhash64(F.lit(seed), "role", "text") for seed in (1, 2)]
    slim = in_order(turns).select("conv_id", "d", F.length("text").cast("long").alias("chars"), digests[0].alias("a"), digests[1].alias("b"))
    slim = slim.select("conv_id", "d", "chars", F.floor((F.col("d") - 1) / CHUNK).alias("piece"), F.xxhash64("d", "a", "b").alias("h1"), F.xxhash64("b", "d", "a").alias("h2"))
    along = Window.partitionBy("conv_id").orderBy("piece")
    before = lambda c: F.coalesce(F.bit_xor(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = slim.groupBy("conv_id", "piece").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count(F.lit(1)).alias("n")).select(
        "conv_id", "piece", before("x1").alias("b1"), before("x2").alias("b2"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns")
    )
    inside = Window.partitionBy("conv_id", "piece").orderBy("d")
    upto = slim.withColumns({"u1": F.bit_xor("h1").over(inside), "u2": F.bit_xor("h2").over(inside)}).join(pieces, ["conv_id", "piece"])
    whole = upto.select("conv_id", "d", "chars", "turns", "h1", "h2", *[F.col(u).bitwiseXOR(F.col(b)).alias(k) for u, b, k in zip(("u1", "u2"), ("b1", "b2"), KEY, strict=True)])
    return whole.select("conv_id", "d", "chars", "turns", *KEY, *[F.col(k).bitwiseXOR(F.col(h)).alias(p) for k, h, p in zip(KEY, ("h1", "h2"), PARENT, strict=True)])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of ``ends`` (conv_id, k1, k2): SHA-256 of the ids that end at a node, ascending and joined by commas.

    The ids of a node run sorted through one task, as a digest of a sequence must, but are never held together.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key1, key2, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if (key1, key2) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (key1, key2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield named(done)
        if now is not None:
            yield named([(*now, state.hexdigest())])

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "ends_sha256"])

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def look_up(rows: DataFrame, keys: list[str], table: DataFrame, spread_by: list[str]) -> DataFrame:
    """Left join with ``table`` (one row for each of ``keys``); the rows of a hot key are dealt in ``SALTS`` parts.

    Only one row for each part asks the table, so the table is not repeated and no key is asked for more than ``SALTS`` times.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    answers = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(answers, [*keys, "_salt"], "left").drop("_salt")


def nodes_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: keys, conv_id, depth, parent_conv_id, n_convs, n_children, weight (turns of members from there on), totals to add."""
    inner = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("d").cast("long").alias("depth"), *[F.min(p).alias(p) for p in PARENT],
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("turns") - F.col("d") + 1).alias("weight"), F.min("chars").alias("chars"),
    )
    n_turns = rows.agg(F.count(F.lit(1))).first()[0]
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast("long").alias(p) for p in PARENT],
        "n_convs", (F.col("n_convs") + n_turns).alias("weight"), F.lit(0).cast("long").alias("chars"),
    )
    nodes = materialize(inner.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)]).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    whole = look_up(nodes.join(children, KEY, "left"), PARENT, parents, KEY).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return whole.select(
        *KEY, *PARENT, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "weight",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )


def split_once(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Split every component of ``state`` at its centroid, the deepest node with more than half of the component's weight.

    All nodes with more than half lie on the path from the centroid to the top; they are given the totals of the centroid's
    subtree, which is cut off: its children are tops of new components. A node asks whether it hangs below the centroid by
    looking up which prefix of its smallest member has the centroid's depth, once for ``CHUNK`` nodes of one member.
    """
    heavy = F.col("weight") * 2 > F.col("total")
    cuts = state.where(heavy).groupBy(*TOP).agg(F.max(F.struct("depth", *KEY, "weight")).alias("c")).select(
        *TOP, F.col("c.depth").alias("c_depth"), F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.col("c.weight").alias("c_weight")
    )
    state = state.withColumn("block", F.floor(F.col("depth") / CHUNK))
    asked = state.where(~heavy).groupBy(*TOP, "conv_id", "block").agg(F.max("depth").alias("deepest")).join(cuts, TOP).where("deepest > c_depth")
    at = rows.select("conv_id", F.col("d").alias("at"), *[F.col(k).alias(f"x{i}") for i, k in enumerate(KEY)], *[F.col(p).alias(f"c{i + 1}") for i, p in enumerate(PARENT)])
    below = asked.withColumn("at", F.col("c_depth") + 1).join(at, ["conv_id", "at", "c1", "c2"])
    weights = state.select(*[F.col(k).alias(f"x{i}") for i, k in enumerate(KEY)], F.col("weight").alias("x_weight"))
    below = below.join(weights, ["x0", "x1"]).select(*TOP, "conv_id", "block", "x0", "x1", "x_weight")
    flagged = materialize(
        state.join(below, [*TOP, "conv_id", "block"], "left").join(cuts, TOP).withColumn("below", F.col("x0").isNotNull() & (F.col("depth") > F.col("c_depth")))
        .withColumn("is_cut", (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).drop("block"),
        "trie-cut",
    )
    gathered = flagged.where("below OR is_cut").groupBy(*TOP).agg(*[F.sum(c).alias(f"sum_{c}") for c in TOTALS])
    path = heavy  # of the weights before the cut
    new_top = [F.when(F.col("below"), F.col(x)).otherwise(F.col(t)).alias(t) for t, x in zip(TOP, ("x0", "x1"), strict=True)]
    joined = flagged.join(gathered, TOP)
    return joined.select(
        *[c for c in flagged.columns if c not in {*TOP, "weight", "total", "below", "is_cut", "x0", "x1", "x_weight", "c_depth", "c1", "c2", "c_weight", *added()}],
        *new_top, *[(F.col(a) + F.when(path, F.col(f"sum_{c}")).otherwise(0)).alias(a) for a, c in zip(added(), TOTALS, strict=True)],
        F.when(path, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
        F.when(F.col("is_cut"), 0).when(F.col("below"), F.col("x_weight")).otherwise(F.col("total") - F.col("c_weight")).alias("total"),
    )


def added() -> list[str]:
    return [f"_{c}" for c in TOTALS]


def roll_up_component(parents: list[int], weight: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums over the subtrees of a tree (node 0 is the top; ``parents`` by number) by splitting it at centroids until nothing is left."""
    children: list[set[int]] = [set() for _ in parents]
    for node, parent in enumerate(parents[1:], 1):
        children[parent].add(node)
    weight = list(weight)
    cuts: list[tuple[int, list[int], list[int]]] = []  # centroid, path above it, tops below it
    tops = [0]
    while tops:
        top = tops.pop()
        total, path = weight[top], [top]
        while (heavy := next((x for x in children[path[-1]] if weight[x] * 2 > total), None)) is not None:
            path.append(heavy)
        centroid = path.pop()
        below = list(children[centroid])
        cuts.append((centroid, path, below))
        tops.extend(below)
        if path:
            children[path[-1]].discard(centroid)
            for node in path:
                weight[node] -= weight[centroid]
            tops.append(top)
    sums = [list(v) for v in values]
    for centroid, path, below in reversed(cuts):  # components below and above a centroid are complete before it
        own = sums[centroid]
        for top in below:
            for i, x in enumerate(sums[top]):
                own[i] += x
        for node in path:
            for i, x in enumerate(own):
                sums[node][i] += x
    return sums


def finish(state: DataFrame) -> DataFrame:
    """(k1, k2, totals) of components with at most ``SMALL`` turns each: a task takes one component after the other."""
    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                if held and row[:2] != held[0][:2]:
                    out += rolled(held)
                    held = []
                held.append(row)
            if out:
                yield named(out)
        if held:
            yield named(rolled(held))

    def rolled(rows):
        place = {row[2:4]: i for i, row in enumerate(rows)}
        parents = [place.get(row[4:6], 0) for row in rows]
        sums = roll_up_component(parents, [row[6] for row in rows], [row[7:9] for row in rows])
        return [(*row[2:4], *[s + a for s, a in zip(own, row[9:], strict=True)]) for row, own in zip(rows, sums, strict=True)]

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[*KEY, *TOTALS])

    wanted = [*TOP, *KEY, *PARENT, "weight", *TOTALS, *added()]
    slim = state.select(*wanted, "depth").repartition(*TOP).sortWithinPartitions(*TOP, "depth").drop("depth")
    return slim.mapInArrow(roll, ", ".join(f"{c} long" for c in [*KEY, *TOTALS]))


def prefix_trie(conversations: DataFrame, members: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """A row for each node of the trie of conversations, which all begin at the textless root.

    Turns are ordered by ``turn_col`` (null first), ties by role and text; repeated rows are turns of their own. A null role
    or text is empty; rows with a null id belong to no conversation. ``members`` (conv_id) may name conversations
    without turns. A node stands for a sequence of first turns (role, text); equal 128-bit fingerprints count as equal
    sequences. Columns: conv_id (smallest member) and depth, which name the node; parent_conv_id (of the root: null);
    n_convs, n_children, n_leaves and saved_tokens ((n_convs - 1) times the code points of the last text, over the subtree);
    ends_sha256 of the ids that end here. Without conversations there are no nodes. Other columns do not matter.

    The sums over subtrees take a number of rounds that grows with the logarithm of the corpus, whatever the depth: each
    splits all components of over ``small`` turns at their centroids; smaller ones are split to the end where they are.
    Nothing is collected; nodes with many members or children are aggregated before they are shuffled, and looked up in parts.
    """
    turns = conversations.select(
        quoted(id_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
        *[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    ).where("conv_id IS NOT NULL")
    rows = materialize(prefixes(turns), "trie-prefixes")
    with_turns = rows.where("d = 1").select("conv_id")
    named = with_turns if members is None else members.select(quoted(members.columns[0]).cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    everyone = with_turns if members is None else materialize(with_turns.unionByName(named).distinct(), "trie-members")
    nodes = materialize(nodes_of(rows, everyone), "trie-nodes")
    root = nodes.where("depth = 0").select("weight").first()
    state = nodes.select(
        *KEY, *PARENT, "conv_id", "depth", "weight", F.lit(root[0] if root else 0).cast("long").alias("total"), *TOTALS,
        *[F.lit(0).cast("long").alias(c) for c in (*added(), *TOP)],
    )
    done: list[DataFrame] = []
    while True:
        is_large = F.col("total") > small
        done.append(finish(state.where(~is_large & (F.col("total") > 0))))
        done.append(state.where("total = 0").select(*KEY, *[F.col(a).alias(c) for a, c in zip(added(), TOTALS, strict=True)]))
        large = state.where(is_large)
        if large.isEmpty():
            break
        state = materialize(split_once(large, rows), "trie-state")
    sums = done[0]
    for part in done[1:]:
        sums = sums.unionByName(part)
    ends = ends_digests(rows.where("d = turns").select("conv_id", *KEY))
    turnless = everyone.join(with_turns, "conv_id", "left_anti").select("conv_id", *[F.lit(0).cast("long").alias(k) for k in KEY])
    ends = ends if members is None else ends.unionByName(ends_digests(turnless))
    return nodes.drop(*TOTALS).join(sums, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *TOTALS, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
