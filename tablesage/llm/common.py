"""What the operators share: shared-folder stages, A-Z lower-casing, and reading a table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(column, UPPER, LOWER)


def beside(df: DataFrame, taken: Sequence[str]) -> list[str]:
    """Columns of ``df`` whose names (in any case) do not clash with result columns."""
    names = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in names]


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def slices(batches, rows: int = 500, size: int = 8_000_000):
    """Cut Arrow batches into parts of at most ``rows`` rows and, beyond one row, about ``size`` bytes."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, size // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
