"""JSON documents and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file holding one JSON array (or object). Missing fields become NULL."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped and the file is split across tasks."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; folders are made, NULL fields are kept so the record shape is stable."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write a stage result as Parquet and hand back a scan of it (the hand-over between stages)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_question_files(
    spark: SparkSession, left_glob: str, left_schema: str, right_glob: str, right_schema: str, key: str = "question_id"
) -> DataFrame:
    """Two folders of per-question files joined by id; a question without a partner is skipped."""
    left = read_json_array(spark, left_glob, left_schema)
    right = read_json_array(spark, right_glob, right_schema)
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key, "inner")
