"""Near-duplicate vectors by randomised-rotation binary codes with correction factors, and exact recomputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import materialize, quoted
from tablesage.llm.components import components

THRESHOLD = 0.98
#: Vectors of a cell that a task compares (home), and others that it compares them with at a time (visitors).
HOME, VISITORS = 1024, 4096
#: Cells of a label have about so many vectors, and codes at most so many bits for the cell.
CELL, CELL_BITS = 1024, 24
SEED = 8
#: Slack for single precision.
SLACK = 1e-4


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed + dimension)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of rotated unit vectors, and the correction factor of each: its inner product with its code, as a unit vector."""
    signs = np.where(rotated >= 0, 1.0, -1.0).astype(np.float32)
    return signs, (signs * rotated).sum(1) / np.sqrt(rotated.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of coded vectors with others."""
    return (signs @ rotated.T.astype(np.float32)) / (np.sqrt(np.float32(rotated.shape[1])) * factors.astype(np.float32))[:, None]


def lowest_estimate(factors: np.ndarray, threshold: float) -> np.ndarray:
    """What the estimate is at least for a vector with a cosine of ``threshold`` or more.

    With y = cos * x + sin * u and u orthogonal to x, the estimate is cos + sin * <code, u> / factor. The code's part
    orthogonal to x has length sqrt(1 - factor^2), which bounds the second term; so the bound holds always, not only
    with high probability, and falls with the angle, so it is lowest at the threshold itself.
    """
    return threshold - np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factors**2)) / factors


def reachable(coordinates: np.ndarray, room: float) -> list[int]:
    """Cells (by the signs of some rotated coordinates) that hold a vector within squared distance ``room``.

    Another sign in a coordinate is a distance of at least its size, so the squares of changed ones add up to no more.
    """
    home = sum(1 << i for i, x in enumerate(coordinates) if x >= 0)
    order = np.argsort(np.abs(coordinates))
    squares = coordinates[order] ** 2
    cells, open_sets = [home], [(home, 0, 0.0)]
    while open_sets:
        cell, at, spent = open_sets.pop()
        for i in range(at, len(order)):
            if spent + squares[i] > room:
                break
            cells.append(cell ^ (1 << int(order[i])))
            open_sets.append((cells[-1], i + 1, spent + squares[i]))
    return cells


def _unit(batch) -> np.ndarray:
    values = batch.column("vector")
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def placed(vectors: DataFrame, threshold: float) -> DataFrame:
    """A row for the home cell of each vector and for each cell that may hold a vector it links with."""
    room = 2 - 2 * threshold + 1e-6

    def place(table: pa.RecordBatch | pa.Table):
        x = _unit(table)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rotated = x @ rotation(x.shape[1])
        bits = table.column("bits").to_pylist()
        rows, cells, home = [], [], []
        for i, k in enumerate(bits):
            found = reachable(rotated[i, :k], room)
            rows += [i] * (len(found) + 1)
            cells += [found[0], *found]
            home += [True, *[False] * len(found)]
        taken = table.select(["label", "dimension", "rep", "copies", "vector"]).take(pa.array(rows, pa.int64()))
        return taken.append_column("cell", pa.array(cells, pa.int64())).append_column("home", pa.array(home))

    def each(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dimensions = table.column("dimension").to_numpy()
            for d in np.unique(dimensions):  # vectors of one length at a time
                for at in range(0, (part := table.filter(pa.array(dimensions == d))).num_rows, 2000):
                    yield from place(part.slice(at, 2000)).to_batches()

    return vectors.mapInArrow(each, "label string, dimension int, rep long, copies long, vector array<double>, cell long, home boolean")


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of the home vectors of a task with its visitors: their numbers, and a link to the smallest of each group."""
    at_home = table.column("home").to_numpy(zero_copy_only=False)
    home, visit = table.filter(pa.array(at_home)), table.filter(pa.array(~at_home))
    ids, others = home.column("rep").to_numpy(), visit.column("rep").to_numpy()
    copies = visit.column("copies").to_numpy()
    links, roots, other_roots = np.zeros(len(ids), np.int64), ids.copy(), others.copy()
    if len(ids) and len(others):
        x, y = _unit(home), _unit(visit)
        x_length, y_length = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        turn = rotation(x.shape[1])
        signs, factors = codes((x / x_length[:, None]) @ turn)
        estimate = estimates(signs, factors, (y / y_length[:, None]) @ turn)
        i, j = np.nonzero((estimate >= (lowest_estimate(factors, threshold) - SLACK)[:, None]) & (ids[:, None] != others[None, :]))
        close = np.zeros(len(i), bool)
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            close[at : at + 100_000] = np.einsum("ij,ij->i", x[a], y[b]) / (x_length[a] * y_length[b]) >= threshold
        i, j = i[close], j[close]
        np.add.at(links, i, copies[j])
        before = None
        while before is None or not (np.array_equal(before[0], roots) and np.array_equal(before[1], other_roots)):
            before = roots.copy(), other_roots.copy()
            np.minimum.at(roots, i, other_roots[j])
            np.minimum.at(other_roots, j, roots[i])
    seen = other_roots != others
    return pa.table({
        "rep": pa.array(np.concatenate([ids, others[seen]])), "links": pa.array(np.concatenate([links, np.zeros(seen.sum(), np.int64)])),
        "root": pa.array(np.concatenate([roots, other_roots[seen]])),
    })


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each vector.

    Vectors with one label and one length of vector link when their cosine, in double precision, is ``threshold`` or
    more. Equal vectors collapse to one with a number of copies. Each label is cut into cells by the signs of rotated
    coordinates, more of them the more vectors it has; a vector visits the cells that can hold a vector near enough, by
    an exact bound. A task takes a bounded part of a cell and of its visitors. There the codes' estimates, with their
    correction factors and bounds, decide which pairs are computed exactly. Pairs are never written: a task returns the
    number of links of each vector and a link to the smallest one it is joined with.

    Vectors that are null, zero, or hold null or non-finite numbers, and rows with a null label or id, link with nothing;
    their component is their own id. Rows are counted and joined by their own label and vector, not by their id: rows that
    repeat all three count as further copies, and of an id with two labels or vectors each row has its own links and component.
    An empty table gives an empty one; extra columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("vector"), quoted(label_col).cast("string").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    valid = rows.where(usable)
    unique = materialize(
        valid.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"dimension": F.size("vector"), "rep": F.monotonically_increasing_id()}), "vectors"
    )
    sizes = unique.groupBy("label", "dimension").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.greatest(F.floor(F.log2(F.col("n") / CELL)), F.lit(0)), F.col("dimension"), F.lit(CELL_BITS)).cast("int")
    spread = materialize(placed(unique.join(sizes.withColumn("bits", bits), ["label", "dimension"]).select("label", "dimension", "rep", "copies", "vector", "bits"), threshold), "vector-cells")
    cells = (
        spread.groupBy("label", "dimension", "cell")
        .agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")).where("homes > 0")
        .select("label", "dimension", "cell", F.ceil(F.col("homes") / HOME).cast("int").alias("home_parts"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("visitor_parts"))
    )
    dealt = spread.join(cells, ["label", "dimension", "cell"])
    own = lambda parts: F.array(F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int"))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    dealt = dealt.withColumn("a", F.explode(F.when(F.col("home"), own("home_parts")).otherwise(every("home_parts"))))
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("home"), every("visitor_parts")).otherwise(own("visitor_parts"))))
    tasks = dealt.select("label", "dimension", "cell", "a", "b", "home", "rep", "copies", "vector").groupBy("label", "dimension", "cell", "a", "b")
    found = materialize(tasks.applyInArrow(lambda table: compare(table, threshold), "rep long, links long, root long"), "vector-links")
    classes = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = unique.select("rep", "first_id").join(classes.withColumnRenamed("node", "rep"), "rep")
    smallest = joined.join(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("rep", "component_id")
    groups = materialize(
        unique.join(counted, "rep", "left").join(smallest, "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")),
        "vector-groups",
    )
    linked = valid.join(groups.hint("merge"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
