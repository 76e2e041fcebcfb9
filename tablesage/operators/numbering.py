"""Row numbers and lists per group that survive one group holding most of the rows.

A plain window puts a whole group on one task. Here every group is cut into chunks along
its own order; rows are numbered inside their chunk, and the chunk's start comes from a
running sum over the (few) chunk counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Along:
    """A chunk expression and the direction in which the group's order runs through it."""

    column: Column
    descending: bool = False


def numbered(
    df: DataFrame,
    by: list[str],
    chunk: list[Along],
    order: list[Column],
    name: str,
    start: int = 0,
    ties: bool = False,
) -> DataFrame:
    """Add ``name``: the position of each row in its group.

    ``chunk`` cuts the group into pieces which do not interleave under ``order``. With ``ties`` equal rows share the first of
    their positions (RANK); equal rows must then fall in the same chunk.
    """
    chunk_names = [f"_chunk{i}" for i in range(len(chunk))]
    keys = by + chunk_names
    pieces = df.withColumns({n: c.column for n, c in zip(chunk_names, chunk)})
    along = Window.orderBy(*[F.col(n).desc() if c.descending else F.col(n).asc() for n, c in zip(chunk_names, chunk)])
    if by:
        along = along.partitionBy(*by)
    before = F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        pieces.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(before, F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    place = F.rank() if ties else F.row_number()
    return (
        pieces.withColumn("_place", place.over(inside))
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_place") - 1 + start)
        .drop("_place", "_start", *chunk_names)
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group. Spark prunes each partition to ``k`` rows per group before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def listed(
    df: DataFrame, by: list[str], position: Column, item: Column, name: str, rows_per_list: int = 1000
) -> DataFrame:
    """Ordered lists per group, one output row per ``rows_per_list`` positions.

    A group of usual size gives exactly one row with ``part`` 0; a huge group gives several,
    so that no list grows without bound and nothing is cut off.
    """
    entry = F.struct(position.alias("at"), item.alias("item"))
    return (
        df.select(*by, F.floor(position / rows_per_list).cast("int").alias("part"), entry.alias("_entry"))
        .groupBy(*by, "part")
        .agg(F.transform(F.array_sort(F.collect_list("_entry")), lambda e: e["item"]).alias(name))
    )
