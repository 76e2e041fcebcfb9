"""Exact duplicates by most-significant-first radix partitioning of the texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import beside, lower_ascii, materialize, quoted

RESULT = ["keep_id", "group_size", "kept"]
#: Characters compared in the first round, and how much longer each next piece is.
FIRST, GROWTH = 64, 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None,
                first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) with ``keep_id`` (id of the row that stays of its equal texts), ``group_size``, ``kept``.

    Each round deals the rows of every open group by the next piece of their text and whether it ends there. A piece
    that one row has makes that row a singleton; a piece at which the texts end makes its rows a group of equal texts.
    Only the other rows go on, with what is left of their texts; pieces grow, so the longest text needs a few rounds.
    Pieces are whole characters, which are equal when their UTF-8 bytes are; no digest is involved.

    A hot group is first counted where it is read (partial aggregation), and only pieces that repeat are joined back, so
    that its rows may be split over any number of tasks. Nothing bounds how many pieces repeat, so they are never
    broadcast: the join is a sort-merge join, whose skewed partitions adaptive execution splits.

    Texts are equal when identical after lower-casing A to Z. A null text counts as empty. Of equal texts the row with
    the largest id stays; a null id is smaller than any other, and of rows that tie in their id exactly one stays. Every
    row of the input, repeated ones too, is a row of the result; an empty table gives an empty one. Input columns named
    as result columns are replaced by these. ``docs`` must give the same rows each time it is read (files do).
    """
    payload = beside(docs, RESULT) if keep is None else list(keep)
    whole = text_col in payload  # then it goes along as it is, and rounds read on at an offset
    rows = docs.select(
        F.struct(*[quoted(c) for c in payload if c != text_col], F.lit(None).cast("string").alias("_none")).alias("payload"),
        quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("body"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.lit(-1).cast("long"))
    result = [F.col("body").alias(c) if c == text_col else F.col("payload")[c].alias(c) for c in payload]
    done: list[DataFrame] = []
    width, offset = first, 0
    while True:
        text = F.coalesce("body", F.lit(""))
        dealt = rows.withColumns({
            "piece": lower_ascii(F.substring(text, F.lit(offset + 1), F.lit(width))),
            "ended": F.substring(text, F.lit(offset + width + 1), F.lit(1)) == "",
        })
        repeated = materialize(
            dealt.groupBy("group", "piece", "ended")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("best"))
            .where("n > 1"),
            "dedup-pieces",
        )
        open_row = F.col("n").isNotNull() & ~F.col("ended")
        rest = F.col("body") if whole else F.when(open_row, F.substring(F.col("body"), F.lit(width + 1), F.lit(2**31 - 1)))
        round_rows = materialize(
            dealt.join(repeated.hint("merge"), ["group", "piece", "ended"], "left")
            .select("payload", "id", "row", "best", "n", open_row.alias("open"), rest.alias("body")),
            "dedup-round",
        )
        done.append(round_rows.where(~F.col("open")).select(
            *result,
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (F.col("n").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        ))
        rows = round_rows.where("open").select("payload", "id", "body", "row", F.col("best.row").alias("group"))
        if rows.isEmpty():
            break
        offset += width if whole else 0
        width *= growth
    united = done[0]
    for part in done[1:]:
        united = united.unionByName(part)
    return united
