"""The corpus pipeline: stages of the operators, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.llm.common import materialize, quoted, table
from tablesage.llm.exact_dedup import exact_dedup
from tablesage.llm.ngram_join import ngram_jaccard
from tablesage.llm.packing import pack, token_pieces
from tablesage.llm.queries import held_out
from tablesage.llm.secret_scan import secret_scan
from tablesage.llm.toxicity import fit_toxicity
from tablesage.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MASK = "[SECRET]"


class Aside:
    """A table whose columns are set aside under names that no result column has."""

    def __init__(self, docs: DataFrame):
        self.names = {name: f"_column{i}" for i, name in enumerate(docs.columns)}
        self.id, self.text = self.names["doc_id"], self.names["text"]
        self.docs = docs.select(*[quoted(c).alias(n) for c, n in self.names.items()])

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).alias(c) for c, n in self.names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels that no test holds out. Columns of any name stay as they are."""
    ship_package(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    aside = Aside(docs)
    return aside.back(model.transform(aside.docs, aside.text).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays. Columns of any name stay as they are."""
    ship_package(spark)
    aside = Aside(docs)
    return aside.back(exact_dedup(aside.docs, aside.id, aside.text).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, one with the smallest id stays (null counts as larger than any).

    Documents are told apart by a 64-bit hash of id and text, so ids may repeat or be null: which document goes is decided by
    its own links. Rows equal in both are one document here and stay or go together; exact copies are the stage before's.
    """
    ship_package(spark)
    key = F.xxhash64("doc_id", "text").alias("_document")
    rows = docs.select(key, "doc_id", "text")
    linked = ngram_jaccard(rows, id_col="_document").select(F.col("doc_id").alias("_document"), "component_id").distinct()
    in_groups = materialize(linked.join(linked.where("_document != component_id").select("component_id").distinct(), "component_id"), "near-copies")
    ids = rows.select("_document", "doc_id").join(in_groups, "_document")
    stays = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_document"))["_document"].alias("stays"))
    goes = in_groups.join(stays, "component_id").where("_document != stays").select("_document")
    aside = Aside(docs)
    named = aside.docs.withColumn("_document", F.xxhash64(aside.id, aside.text))
    return aside.back(named.join(goes, "_document", "left_anti"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mask, and ``n_chars``, where there is one, counts anew."""
    ship_package(spark)
    aside = Aside(docs)
    masked = aside.back(secret_scan(aside.docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text_col=aside.text, mask=MASK))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 2048."""
    ship_package(spark)
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]

#: Toxicity, secrets and packing need learned weights, vocabularies and a tokenizer, which SQL does not have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
