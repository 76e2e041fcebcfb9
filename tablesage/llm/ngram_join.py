"""Documents whose word n-gram sets have a high Jaccard similarity, by a blocked sparse matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import materialize, quoted, slices, texts_of
from tablesage.llm.components import components
from tablesage.llm.shingles import set_ids, shingle_sets

#: Two sets link when SCALE * overlap >= NEEDED * union: a similarity of 0.75.
NEEDED, SCALE = 75, 100
#: Hashes that a task gathers before it passes them on.
GATHERED = 2_000_000
#: Representatives of a column that the rounds compare others with, before what is left is compared in full.
ROUNDS = (1, 8)
#: Sets that a task compares with one representative; rows and columns of a block of the last product.
PART, BLOCK_ROWS, BLOCK_COLUMNS = 512, 128, 1024

SETS = "set long, size int, shared int, hashes binary, prefix array<long>"


def _least(size):
    """The smallest overlap that a set of this size can link with: NEEDED hundredths of it, rounded up."""
    return -(-size * NEEDED // SCALE)


def _block(number: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a uniform 64-bit number: equal ranges of its top bits."""
    return ((number.view(np.uint64) >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def _cells(block: np.ndarray, sets: np.ndarray, sizes: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row per block: its sets, their sizes and numbers of entries, and the entries, set by set, as binary columns."""
    order = np.lexsort((sets, block))
    block, sets, sizes = block[order], sets[order], sizes[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (sets[1:] != sets[:-1])
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, len(block))).astype(np.int32)
    cuts = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else np.zeros(0, np.int64)
    bounds = np.append(cuts, len(block))
    run_bounds = np.searchsorted(runs, bounds)
    entries = {name: values[order] for name, values in columns.items()}
    out = {"block": block[cuts].astype(np.int32).tolist(), "sets": [], "sizes": [], "lengths": [], **{name: [] for name in entries}}
    for a, b, x, y in zip(bounds[:-1], bounds[1:], run_bounds[:-1], run_bounds[1:], strict=True):
        at = runs[x:y]
        out["sets"].append(sets[at].tobytes())
        out["sizes"].append(sizes[at].astype(np.int32).tobytes())
        out["lengths"].append(lengths[x:y].tobytes())
        for name, values in entries.items():
            out[name].append(values[a:b].tobytes())
    return pa.record_batch({name: pa.array(v, pa.int32() if name == "block" else pa.binary()) for name, v in out.items()})


def _entries(table: pa.Table, kinds: dict[str, type]) -> tuple[np.ndarray, ...]:
    """Set, size and values of each entry of a block's cells."""
    read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    lengths = read("lengths", np.int32)
    return np.repeat(read("sets", np.int64), lengths), np.repeat(read("sizes", np.int32), lengths), *[read(n, k) for n, k in kinds.items()]


def incidence(docs: DataFrame, blocks: int, words: int) -> DataFrame:
    """The matrix of sets by n-grams, cut into blocks of n-grams; a task passes on each set once for what it gathers."""

    def gather(batches):
        hashes, sets, sizes, counts, held = [], [], [], [], 0
        for batch in slices(batches):
            found, number = shingle_sets(texts_of(batch), words)
            hashes.append(found)
            sets.append(set_ids(found, number))
            counts.append(number)
            held += len(found)
            if held >= GATHERED:
                yield _gathered(hashes, sets, counts, blocks)
                hashes, sets, counts, held = [], [], [], 0
        if held:
            yield _gathered(hashes, sets, counts, blocks)

    return docs.select("text").mapInArrow(gather, "block int, sets binary, sizes binary, lengths binary, hashes binary")


def _gathered(hashes: list, sets: list, counts: list, blocks: int) -> pa.RecordBatch:
    hashes, sets, counts = np.concatenate(hashes), np.concatenate(sets), np.concatenate(counts)
    first = np.zeros(len(sets), bool)
    first[np.unique(sets, return_index=True)[1]] = True
    keep = np.repeat(first, counts)
    hashes = hashes[keep]
    return _cells(_block(hashes, blocks), np.repeat(sets, counts)[keep], np.repeat(counts, counts)[keep], {"hashes": hashes})


def shared_entries(matrix: DataFrame, blocks: int) -> DataFrame:
    """Of each n-gram column, the entries of sets that share it with a set of a size they can link with; by blocks of sets."""

    def share(table: pa.Table) -> pa.Table:
        sets, sizes, hashes = _entries(table, {"hashes": np.uint64})
        order = np.lexsort((sets, sizes, hashes))
        sets, sizes, hashes = sets[order], sizes[order].astype(np.int64), hashes[order]
        new = np.ones(len(sets), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1])
        sets, sizes, hashes = sets[new], sizes[new], hashes[new]
        same = hashes[1:] == hashes[:-1]
        near = same & (SCALE * sizes[:-1] >= NEEDED * sizes[1:])  # neighbours by size
        useful = np.zeros(len(sets), bool)
        useful[1:] |= near
        useful[:-1] |= near
        starts = np.flatnonzero(np.append(True, ~same)) if len(sets) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(np.append(starts, len(sets))), np.diff(np.append(starts, len(sets))))
        grade = np.minimum(255, 8 * np.log2(np.maximum(many, 1))).astype(np.uint8)
        return pa.Table.from_batches([_cells(_block(sets[useful], blocks), sets[useful], sizes[useful], {"hashes": hashes[useful], "grades": grade[useful]})])

    return matrix.groupBy("block").applyInArrow(share, "block int, sets binary, sizes binary, lengths binary, hashes binary, grades binary")


def linkable_sets(entries: DataFrame) -> DataFrame:
    """Sets that share enough n-grams to link with any other: their shared n-grams, and the rarest of them as prefix.

    A set of n n-grams links only with an overlap of ``_least(n)`` or more. The prefix leaves out so many of the most
    frequent ones that two sets which link have one of their prefixes in common.
    """

    def gather(table: pa.Table) -> pa.Table:
        sets, sizes, hashes, grades = _entries(table, {"hashes": np.uint64, "grades": np.uint8})
        order = np.lexsort((hashes, grades, sets))
        sets, sizes, hashes = sets[order], sizes[order], hashes[order]
        starts = np.flatnonzero(np.diff(sets, prepend=sets[:1] - 1)) if len(sets) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(sets))
        rows = []
        for a, b in zip(starts, ends, strict=True):
            extra = (b - a) - _least(int(sizes[a]))
            if extra >= 0:
                rows.append((int(sets[a]), int(sizes[a]), int(b - a), np.sort(hashes[a:b]).tobytes(), hashes[a : a + extra + 1].view(np.int64)))
        kinds = [("set", pa.int64()), ("size", pa.int32()), ("shared", pa.int32()), ("hashes", pa.binary()), ("prefix", pa.list_(pa.int64()))]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    return entries.groupBy("block").applyInArrow(gather, SETS)


def overlapping(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (one, other) the pairs of sets that link, by their exact overlap. Each set is fetched once for all its pairs' tasks.

    Sets that are compared with one other are dealt out in parts, each with a copy of it, which its task holds alone.
    """
    parts = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "other").select("one", "other", F.pmod(F.xxhash64("one"), F.col("parts")).cast("int").alias("part"))
    wanted = dealt.select(F.col("one").alias("set"), "other", "part", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("other").alias("set"), "other", "part", F.lit(0).alias("role")).distinct()
    )
    rows = wanted.join(sets.select("set", "size", "hashes"), "set")
    sorted_rows = rows.repartition("other", "part").sortWithinPartitions("other", "part", "role")

    def compare(batches):
        held, held_size = None, 0
        for batch in batches:
            ones, others = [], []
            for name, other, role, size, data in zip(*[batch.column(c).to_pylist() for c in ("set", "other", "role", "size", "hashes")], strict=True):
                hashes = np.frombuffer(data, np.uint64)
                if role == 0:
                    held, held_size = hashes, size
                else:
                    both = np.concatenate([held, hashes])
                    both.sort(kind="stable")
                    overlap = int((both[1:] == both[:-1]).sum())
                    if SCALE * overlap >= NEEDED * (held_size + size - overlap):
                        ones.append(name)
                        others.append(other)
            yield pa.record_batch({"a": pa.array(ones, pa.int64()), "b": pa.array(others, pa.int64())})

    return sorted_rows.mapInArrow(compare, "a long, b long")


def products(columns: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b: classes) between the sets outside the largest class of a column and all others that meet them.

    Columns with one largest class form a group: its rows are the sets outside that class, its columns all of its sets.
    A task multiplies a block of rows with a part of the columns: it holds the block's n-grams and adds up the overlaps of
    one column after the other. Sets are dealt out, not pairs, so a group of near copies costs rows as it grows, not
    their square.
    """
    members = columns.groupBy("largest", "set").agg(F.max("class").alias("class")).withColumn("outside", F.col("class") != F.col("largest"))
    sizes = members.groupBy("largest").agg(
        F.ceil(F.count_if("outside") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / BLOCK_COLUMNS).cast("int").alias("parts")
    )
    dealt = members.join(sizes, "largest")
    own = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = dealt.where("outside").select("set", "class", "largest", own("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("role"))
    others = dealt.select("set", "class", "largest", every("blocks").alias("block"), own("parts").alias("part"), F.lit(1).alias("role"))
    wanted = materialize(rows.unionByName(others), "ngram-blocks")
    task = ["largest", "block", "part"]
    sorted_rows = wanted.join(sets.select("set", "size", "hashes"), "set").repartition(*task).sortWithinPartitions(*task, "role")

    def multiply(batches):
        key, held = None, []
        grams = owners = sizes = classes = names = None
        for batch in batches:
            links = set()
            columns_of = [batch.column(c).to_pylist() for c in (*task, "role", "set", "class", "size", "hashes")]
            for largest, block, part, role, name, group, size, data in zip(*columns_of, strict=True):
                if (largest, block, part) != key:
                    key, held, grams = (largest, block, part), [], None
                hashes = np.frombuffer(data, np.uint64)
                if role == 0:
                    held.append((name, group, size, hashes))
                    continue
                if not held:
                    continue
                if grams is None:
                    grams, owners = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
                    order = np.argsort(grams, kind="stable")
                    grams, owners = grams[order], owners[order]
                    names, classes, sizes = (np.array([h[i] for h in held], np.int64) for i in range(3))
                first, last = np.searchsorted(grams, hashes, "left"), np.searchsorted(grams, hashes, "right")
                number = last - first
                at = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
                overlap = np.bincount(owners[at], minlength=len(held))
                linked = (SCALE * overlap >= NEEDED * (sizes + size - overlap)) & (names != name) & (classes != group)
                links.update((min(c, group), max(c, group)) for c in classes[linked].tolist())
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sorted_rows.mapInArrow(multiply, "a long, b long")


def _representatives(columns: DataFrame, number: int) -> DataFrame:
    """Pairs (one, other) of sets of different classes: those outside a column's largest class, and ``number`` sets of it."""
    salt = F.pmod(F.xxhash64("set", F.lit(number)), F.lit(number))
    best = columns.where("class = largest").groupBy("column", salt.alias("salt")).agg(F.min(F.struct("set", "size", "shared", "class")).alias("best"))
    other = best.select("column", *[F.col(f"best.{c}").alias(f"other_{c}") for c in ("set", "size", "shared", "class")])
    bound = NEEDED * (F.col("size") + F.col("other_size")) <= (NEEDED + SCALE) * F.least("shared", "other_shared")
    return (
        columns.where("class != largest").join(other, "column").where(bound)
        .where(NEEDED * F.greatest("size", "other_size") <= SCALE * F.least("size", "other_size"))
        .select(F.col("set").alias("one"), F.col("other_set").alias("other"), F.col("class").alias("class_one"), F.col("other_class").alias("class_other"))
        .distinct()
    )


def linked_classes(sets: DataFrame) -> DataFrame:
    """(set, class) of linked sets.

    The prefixes' columns hold all pairs that may link, but sets that are known to belong together need no comparison:
    a column's largest class is represented by 1, then 8 of its sets, against which the others are compared; columns of
    one class are done. What is left in the end, the sets outside the largest class, is multiplied with every set that
    meets them, so no link is lost, and near copies of one text never meet in all pairs.
    """
    columns = materialize(sets.select("set", "size", "shared", F.explode("prefix").alias("column"), F.col("set").alias("class")), "ngram-columns")
    classes: DataFrame | None = None
    for number in (*ROUNDS, None):
        per_class = columns.groupBy("column", "class").agg(F.count(F.lit(1)).alias("n"))
        mixed = per_class.groupBy("column").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        columns = materialize(columns.join(mixed.select("column", F.col("top.class").alias("largest")), "column"), "ngram-columns")
        if columns.isEmpty():
            break
        if number is None:
            links = products(columns, sets)
        else:
            pairs = materialize(_representatives(columns, number), "ngram-pairs")
            found = overlapping(pairs.select("one", "other"), sets).join(pairs.withColumnsRenamed({"one": "a", "other": "b"}), ["a", "b"])
            links = found.select(F.col("class_one").alias("a"), F.col("class_other").alias("b"))
        merged = materialize(components(links), "ngram-classes")
        renamed = merged.select(F.col("node").alias("class"), "component")
        if classes is None:
            classes = merged.select(F.col("node").alias("set"), F.col("component").alias("class"))
        else:
            known = classes.join(renamed, "class", "left").select("set", F.coalesce("component", "class").alias("class"))
            fresh = merged.select(F.col("node").alias("set"), F.col("component").alias("class")).join(known.select("set"), "set", "left_anti")
            classes = materialize(known.unionByName(fresh), "ngram-classes")
        if number is not None:
            columns = columns.drop("largest").join(renamed, "class", "left").withColumn("class", F.coalesce("component", "class")).drop("component")
            columns = materialize(columns, "ngram-columns")
    return classes if classes is not None else sets.select("set", F.col("set").alias("class")).limit(0)


def ngram_jaccard(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links of similarity 0.75 or more lead to).

    Equal sets collapse to one before anything is compared. The documents' sets are rows of a sparse 0/1 matrix whose
    columns are n-grams; its product with its transpose holds the overlaps. Blocks of columns find the entries that can
    add to any overlap at all; sets whose bound on it is too small for their size are discarded, then pairs; what is left
    is counted exactly. See the functions for how each step stays within its task.

    Words are lower-cased (A to Z); a text of fewer words than ``words`` has one n-gram of all; a null or empty text, or
    one without words, has none and links with nothing. N-grams are compared by 64-bit hashes. Rows with a null id are
    linked but name no component; repeated rows are rows of the result each. Extra columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def name_sets(batches):
        for batch in slices(batches):
            hashes, counts = shingle_sets(texts_of(batch), words)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(counts.astype(np.int64)), "set": pa.array(set_ids(hashes, counts))})

    named = materialize(rows.mapInArrow(name_sets, "doc_id long, n_shingles long, set long"), "ngram-documents")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = materialize(linkable_sets(shared_entries(incidence(rows, blocks, words), blocks)), "ngram-sets")
    classes = linked_classes(sets)
    placed = materialize(named.where("n_shingles > 0").join(classes, "set", "left").select("doc_id", "n_shingles", F.coalesce("class", "set").alias("class")), "ngram-placed")
    first = materialize(placed.groupBy("class").agg(F.min("doc_id").alias("component_id")), "ngram-first")
    return placed.join(first, "class").select("doc_id", "n_shingles", "component_id").unionByName(
        named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
