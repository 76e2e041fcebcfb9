"""Token ids as Parquet files in document order, and their selective reading."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesage.llm.common import quoted, slices
from tablesage.llm.word_encoding import word_encoder

#: Ids under a dictionary (a vocabulary is one), the other columns as deltas; row groups and pages small enough that a
#: reader of a few documents skips most of them by the page indexes, which Parquet writers of version 2 always add.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, kind: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one row per document to ``path``: doc_id, part, start_in_part, n_tokens (with ``end_id``) and ids.

    Documents are range-partitioned and sorted by id, so files hold consecutive ids and their statistics and page indexes
    cut a reader's work. Null ids come first; equal ids are ordered by a hash of their texts and all kept; a null text is
    empty and has the end id only. Extra columns are left out. An empty table gives files without rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        encoder = word_encoder(vocabulary, kind)
        for batch in slices(batches, 2000):
            values, lengths = encoder.encode_batch(batch.column("text"), end_id)
            ends = np.cumsum(lengths)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "part": pa.array(np.full(len(lengths), part, np.int32)),
                "start_in_part": pa.array(at + ends - lengths),
                "n_tokens": pa.array(lengths),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view(np.int32))),
            })
            at += int(lengths.sum())

    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
    ranged.mapInArrow(encode, schema).write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Rows of token files with ``start``, the ids of all documents before each. Filters on doc_id reach the page indexes.

    ``start`` needs the totals of the parts: one pass over the ``n_tokens`` column, summed to a row per part.
    These few rows are broadcast: there are as many as the writing job had partitions, so the ids are not shuffled.
    """
    files = spark.read.parquet(path)
    if "start" not in columns:
        return files.select(*columns)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("start_in_part")).select(*columns)


def ids_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
