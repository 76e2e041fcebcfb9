"""Frequencies of column values without a shuffle of all cells.

One scan keeps a bounded state for each column in each task: the values met and how often, and when there are too many of
them a number is taken off all counts and remembered as slack. States add up: the true count of a value lies between its
counted sum and that sum plus the column's slack, and a value that no state holds occurs at most slack times.

* A column without slack is known exactly: its values, their number and counts are in the states.
* Where the k-th largest counted sum exceeds the slack, the sums name the candidates of the k most frequent values, and a
  second scan counts these alone.
* Other columns are flat: almost all their values are rare. Only of these, fingerprints of the values (128 bits, or the number
  itself) are counted in a shuffle, which gives exact distinct and k-th counts; texts are fetched for what reaches them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.operators.numbering import top_per_group
from tablesage.session import stable
from tablesage.sources.catalog import spread

#: Values that a state holds of a column, values that one with slack hands on, and rows that are added at a time.
CAPACITY, HANDED_ON, ROWS_AT_ONCE = 131_072, 8192, 200_000
#: So many values of equal count at most are fetched by fingerprint; beyond, the smallest are found by their order.
TIES = 1000
#: Bytes from which a table in fewer splits than there are cores is spread.
SPREAD_FROM = 1 << 20

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SUMS = ["count", "slack", "nulls"]
STATE = "column_no int, whole long, real double, text string, count long, slack long, nulls long"


def unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scanned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what is read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def kind_of(data_type: T.DataType) -> str:
    """How values are carried: as integers, as doubles, or as text."""
    if isinstance(data_type, INTEGERS):
        return "whole"
    return "real" if isinstance(data_type, T.DoubleType) else "text"


def carried(field: T.StructField) -> Column:
    value = F.col(f"`{field.name.replace('`', '``')}`")
    return value.cast({"whole": "long", "real": "double", "text": "string"}[kind_of(field.dataType)])


def as_text() -> Column:
    """The value of a (whole, real, text) row as text."""
    return F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))


def fingerprint(kind: str, value: Column) -> tuple[Column, Column]:
    """Two numbers that name a value of its column."""
    if kind == "whole":
        return value, F.when(value.isNotNull(), F.lit(0).cast("long"))
    return tuple(F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)) for seed in (1, 2))


def extremes_of(table: DataFrame, wanted: list[tuple[int, T.StructField]], first: int) -> DataFrame:
    """(column_no, total_rows, null_count, min_value, max_value) of some columns, in their own types, from one wide aggregate."""
    column = lambda f: F.col(f"`{f.name.replace('`', '``')}`")
    wide = table.agg(F.count(F.lit(1)).alias("rows"), *[m for i, f in wanted for m in (F.count(column(f)).alias(f"n_{i}"), F.min(column(f)).alias(f"lo_{i}"), F.max(column(f)).alias(f"hi_{i}"))])
    entries = [F.struct(
        F.lit(first + i).alias("column_no"), F.col("rows").alias("total_rows"), (F.col("rows") - F.col(f"n_{i}")).alias("null_count"),
        F.col(f"lo_{i}").cast("string").alias("min_value"), F.col(f"hi_{i}").cast("string").alias("max_value"),
    ) for i, _ in wanted]
    return wide.select(F.inline(F.array(*entries)))


def shrunk(state: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """At most ``capacity`` values of a state (value, count), and what had to be taken off every count."""
    if state.num_rows <= capacity:
        return state, 0
    counts = state["count"].to_numpy()
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = state.set_column(1, "count", pc.subtract(state["count"], pa.scalar(off, pa.int64())))
    return left.filter(pc.greater(left["count"], 0)), off


def fold(held: pa.Table | None, values: pa.Array, capacity: int) -> tuple[pa.Table, int]:
    """Add ``values`` to a state; returns it with what had to be taken off every count."""
    counted = values.drop_null().value_counts()
    merged = pa.table({"value": counted.field(0), "count": counted.field(1)})
    if held is not None:
        both = pa.concat_tables([held, merged]).group_by("value").aggregate([("count", "sum")])
        merged = pa.table({"value": both["value"], "count": both["count_sum"]})
    return shrunk(merged, capacity)


def _states(table: DataFrame, first: int, capacity: int, rows_at_once: int) -> DataFrame:
    """The states of one table's columns, a row for each value held in a task and one for the slack and the nulls."""
    fields = table.schema.fields
    kinds = [kind_of(f.dataType) for f in fields]
    plain = table.select(*[carried(f).alias(f"c{i}") for i, f in enumerate(fields)])

    def collect(batches):
        held: list[pa.Table | None] = [None] * len(kinds)
        slack, nulls = [0] * len(kinds), [0] * len(kinds)
        waiting: list[pa.RecordBatch] = []

        def add():
            for i in range(len(kinds)):
                column = pa.chunked_array([b.column(i) for b in waiting]).combine_chunks()
                held[i], off = fold(held[i], column, capacity)
                slack[i] += off
                nulls[i] += column.null_count
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= rows_at_once:
                add()
        if waiting:
            add()
        for i, kind in enumerate(kinds):
            state = held[i]
            if slack[i]:
                state, off = shrunk(state, min(capacity, HANDED_ON))
                slack[i] += off
            n = 0 if state is None else state.num_rows
            columns = {k: pa.nulls(n + 1, t) for k, t in (("whole", pa.int64()), ("real", pa.float64()), ("text", pa.string()))}
            if n:
                values = state["value"].combine_chunks().cast(columns[kind].type)
                columns[kind] = pa.concat_arrays([values, pa.nulls(1, values.type)])
            counts = [] if state is None else state["count"].to_pylist()
            yield pa.record_batch({
                "column_no": pa.array([first + i] * (n + 1), pa.int32()), **columns, "count": pa.array([*counts, 0], pa.int64()),
                "slack": pa.array([0] * n + [slack[i]], pa.int64()), "nulls": pa.array([0] * n + [nulls[i]], pa.int64()),
            })

    return plain.mapInArrow(collect, STATE)


@dataclass
class ValueStates:
    """States of all columns of ``tables``; column numbers count through the tables' columns in order."""

    tables: dict[str, DataFrame]
    capacity: int = CAPACITY
    rows_at_once: int = ROWS_AT_ONCE
    ties: int = TIES

    @cached_property
    def columns(self) -> list[tuple[str, T.StructField]]:
        return [(name, field) for name, df in self.tables.items() for field in df.schema.fields]

    @cached_property
    def counted(self) -> DataFrame:
        """(column_no, whole, real, text, count, slack, nulls): sums of the states, written once; slack and nulls are in the row without a value."""
        parts, first = [], 0
        for df in self.tables.values():
            parts.append(_states(spread(df) if scanned_bytes(df) >= SPREAD_FROM else df, first, self.capacity, self.rows_at_once))
            first += len(df.schema.fields)
        return stable(unite(parts).groupBy("column_no", "whole", "real", "text").agg(*[F.sum(c).alias(c) for c in SUMS]))

    @cached_property
    def slack(self) -> dict[int, int]:
        """The slack of each column that has some; one number a column."""
        return {r.column_no: r.slack for r in self.counted.where("slack > 0").select("column_no", "slack").collect()}

    def held(self) -> DataFrame:
        return self.counted.where("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL")

    def names(self, df: DataFrame) -> DataFrame:
        """``df`` with table_name and column_name in place of column_no."""
        tables = F.array(*[F.lit(t) for t, _ in self.columns])
        names = F.array(*[F.lit(f.name) for _, f in self.columns])
        rest = [c for c in df.columns if c != "column_no"]
        return df.select(F.get(tables, F.col("column_no")).alias("table_name"), F.get(names, F.col("column_no")).alias("column_name"), *rest)

    def cells(self, wanted: list[int], with_values: bool) -> DataFrame:
        """(column_no, h1, h2[, whole, real, text]) of the cells of some columns that are not null; a generator, no shuffle."""
        parts, first = [], 0
        for df in self.tables.values():
            entries = []
            for i, field in enumerate(df.schema.fields):
                if first + i in wanted:
                    kind, value = kind_of(field.dataType), carried(field)
                    h1, h2 = fingerprint(kind, value)
                    values = [(value if kind == k else F.lit(None)).cast(t).alias(k) for k, t in (("whole", "long"), ("real", "double"), ("text", "string"))]
                    entries.append(F.struct(F.lit(first + i).alias("column_no"), h1.alias("h1"), h2.alias("h2"), *(values if with_values else [])))
            first += len(df.schema.fields)
            if entries:
                parts.append(df.select(F.inline(F.array(*entries))).where("h1 IS NOT NULL"))
        return unite(parts)

    @cached_property
    def flat(self) -> DataFrame:
        """(column_no, h1, h2, count) of the columns with slack: the one shuffle, of fixed-width numbers."""
        return stable(self.cells(sorted(self.slack), False).groupBy("column_no", "h1", "h2").agg(F.count(F.lit(1)).alias("count")))

    def distinct_counts(self) -> DataFrame:
        """(column_no, distinct_count), exact; two values whose 128-bit fingerprints agree count as one. Columns without values are left out."""
        exact = self.held().where(~F.col("column_no").isin(list(self.slack))).groupBy("column_no").agg(F.count(F.lit(1)).alias("distinct_count"))
        if not self.slack:
            return exact
        return exact.unionByName(self.flat.groupBy("column_no").agg(F.count(F.lit(1)).alias("distinct_count")))

    def measures(self) -> DataFrame:
        """(column_no, total_rows, null_count, min_value, max_value).

        Extremes come from the states where these are exact and ordered as the column is; only the other columns are scanned
        again, for one row a table and task.
        """
        again = [i for i, (_, f) in enumerate(self.columns) if i in self.slack or isinstance(f.dataType, (T.DecimalType, T.FloatType))]
        sums = self.counted.groupBy("column_no").agg((F.sum("count") + F.sum("nulls")).alias("seen"), F.sum("nulls").alias("null_count"),
            *[g(k).alias(f"{n}_{k}") for k in ("whole", "real") for n, g in (("lo", F.min), ("hi", F.max))])
        texts = self.counted.where("text IS NOT NULL").groupBy("column_no").agg(F.min("text").alias("lo_text"), F.max("text").alias("hi_text"))
        extremes = [F.coalesce(f"{n}_text", F.col(f"{n}_whole").cast("string"), F.col(f"{n}_real").cast("string")).alias(a) for n, a in (("lo", "min_value"), ("hi", "max_value"))]
        known = sums.where(~F.col("column_no").isin(again)).join(texts, "column_no", "left").select("column_no", F.col("seen").alias("total_rows"), "null_count", *extremes)
        parts, first = [known], 0
        for df in self.tables.values():
            wanted = [(i, f) for i, f in enumerate(df.schema.fields) if first + i in again]
            if wanted:
                parts.append(extremes_of(df, wanted, first))
            first += len(df.schema.fields)
        return unite(parts)

    def distinct_values(self) -> DataFrame:
        """(table_name, column_name, value) of all values; those of columns with slack come as often as the table has them."""
        exact = self.held().where(~F.col("column_no").isin(list(self.slack))).select("column_no", as_text().alias("value"))
        if self.slack:
            exact = exact.unionByName(self.cells(sorted(self.slack), True).select("column_no", as_text().alias("value")))
        return self.names(exact)

    def top(self, k: int) -> DataFrame:
        """(column_no, value, count): at least the ``k`` most frequent values of each column, ties by the text; exact counts."""
        held = self.held().select("column_no", "whole", "real", "text", "count")
        found = [held.where(~F.col("column_no").isin(list(self.slack))).select("column_no", as_text().alias("value"), "count")]
        if self.slack:
            least = {r.column_no: r.c for r in top_per_group(held.where(F.col("column_no").isin(list(self.slack))), ["column_no"], [F.col("count").desc()], k)
                     .groupBy("column_no").agg(F.min("count").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
            settled = {c: least[c] - s for c, s in self.slack.items() if least.get(c, 0) > s}
            flat = [c for c in self.slack if c not in settled]
            if settled:
                found.append(self._counted_again(held, settled))
            if flat:
                found += self._top_of_flat(flat, k)
        return unite(found)

    def _counted_again(self, held: DataFrame, settled: dict[int, int]) -> DataFrame:
        """Exact counts of the values whose counted sum reaches the number given for their column."""
        asked = unite([held.where((F.col("column_no") == c) & (F.col("count") >= n)).drop("count") for c, n in settled.items()])
        by_kind = [asked.where(F.col(kind).isNotNull()).select("column_no", *[h.alias(n) for h, n in zip(fingerprint(kind, F.col(kind)), ("h1", "h2"), strict=True)], as_text().alias("value"))
                   for kind in ("whole", "real", "text")]
        counts = self.cells(sorted(settled), False).join(unite(by_kind), ["column_no", "h1", "h2"]).groupBy("column_no", "value").agg(F.count(F.lit(1)).alias("count"))
        return counts.select("column_no", "value", "count")

    def _top_of_flat(self, flat: list[int], k: int) -> list[DataFrame]:
        """The k-th count of each column decides: values above it, fewer than k, are fetched by fingerprint, and so are those of
        that count if they are few. Else the smallest are taken: of a column whose other values all occur once by a bounded sort
        in each task, else among the cells that have such a count."""
        counts = self.flat.where(F.col("column_no").isin(flat))
        downward = Window.partitionBy("column_no").orderBy(F.col("count").desc())  # of counts, not of values
        levels = counts.groupBy("column_no", "count").agg(F.count(F.lit(1)).alias("ties")).withColumn("above", F.sum("ties").over(downward) - F.col("ties"))
        told = {r.column_no: r.kth for r in levels.where(F.col("above") < k).groupBy("column_no").agg(F.min(F.struct("count", "above", "ties")).alias("kth")).collect()}
        kth = {c: r["count"] for c, r in told.items()}
        bound = F.element_at(F.create_map(*[F.lit(x) for pair in kth.items() for x in pair]), F.col("column_no"))
        many = [c for c in kth if told[c].ties > self.ties]
        reaching = (F.col("count") > bound) | ((F.col("count") == bound) & ~F.col("column_no").isin(many))
        fetched = [c for c in kth if c not in many or told[c].above]
        key = ["column_no", "h1", "h2"]
        found = []
        if fetched:  # at most k - 1 and ``ties`` rows a column
            found.append(self._fetch(fetched, F.broadcast(counts.where(reaching & F.col("column_no").isin(fetched)))))
        for c in many:
            missing = k - told[c].above
            above = F.broadcast(counts.where((F.col("column_no") == c) & (F.col("count") > kth[c])).select(*key))  # fewer than k rows
            if kth[c] == 1:
                others = self.cells([c], True).join(above, key, "left_anti") if told[c].above else self.cells([c], True)
                found.append(others.select("column_no", as_text().alias("value"), F.lit(1).cast("long").alias("count")).orderBy("value").limit(missing))
        tied = [c for c in many if kth[c] > 1]
        if tied:
            rows = self._fetch(tied, counts.where((F.col("count") == bound) & F.col("column_no").isin(tied)))
            found.append(top_per_group(rows, ["column_no"], [F.col("value")], k).drop("rank"))
        return found

    def _fetch(self, columns: list[int], asked: DataFrame) -> DataFrame:
        """The texts of fingerprints (column_no, h1, h2, count)."""
        cells = self.cells(columns, True).join(asked, ["column_no", "h1", "h2"])
        return cells.groupBy("column_no", "h1", "h2").agg(F.min(as_text()).alias("value"), F.first("count").alias("count")).select("column_no", "value", "count")
