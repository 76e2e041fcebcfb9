"""Table and column metadata, as small DataFrames, and plain table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_SCHEMA = "db_id string, table_name string"
COLUMN_SCHEMA = (
    "db_id string, table_name string, column_name string, ordinal int, data_type string,"
    " not_null boolean, primary_key boolean"
)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """One lazily scanned DataFrame per ``<folder>/<name>.parquet``."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def spread(scan: DataFrame) -> DataFrame:
    """A plain table scan over at least as many tasks as there are cores.

    For work that costs much per row: a small table that comes as one file split would keep
    a single core busy. A scan with enough splits, as any large table has, is left alone and
    gets no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL text over named DataFrames without leaving views behind for other callers."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def list_tables(spark: SparkSession, db_id: str | None = None, hidden_prefix: str | None = "sqlite_") -> DataFrame:
    """User tables and views of a catalog database; names starting with ``hidden_prefix`` are left out."""
    rows = [
        (db_id or spark.catalog.currentDatabase(), t.name)
        for t in spark.catalog.listTables(db_id)
        if not (hidden_prefix and t.name.lower().startswith(hidden_prefix))
    ]
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def column_metadata(spark: SparkSession, tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """Name, type and nullability of every column. Spark tables carry no primary key, so that is NULL."""
    rows = [
        (db_id, table, field.name, i, field.dataType.simpleString(), not field.nullable, None)
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def with_table_views(tables: dict[str, DataFrame]) -> None:
    """Register each DataFrame as a temporary view, for SQL texts that name the tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)

