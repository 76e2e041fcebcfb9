"""Registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.functions.binding import let
from tablesage.llm.byte_bpe import encode_and_decode
from tablesage.llm.common import lower_ascii, materialize, stage_path, table
from tablesage.llm.embedding_dedup import near_vectors
from tablesage.llm.exact_dedup import exact_dedup
from tablesage.llm.language_id import fit_languages
from tablesage.llm.ngram_join import ngram_jaccard
from tablesage.llm.packing import pack, token_pieces
from tablesage.llm.periodic_runs import periodic_runs
from tablesage.llm.prefix_trie import in_order, prefix_trie
from tablesage.llm.quality_rules import COUNTS, quality_rules
from tablesage.llm.secret_scan import KINDS, joined, secret_scan
from tablesage.llm.token_counts import token_counts
from tablesage.llm.token_files import ids_digest, read_tokens, write_tokens
from tablesage.llm.toxicity import fit_toxicity
from tablesage.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: A-Z lower-casing in SQL.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op3_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS t FROM documents)
WINDOW same AS (PARTITION BY t)
""")
def op3_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256).alias("text_sha256")
    )
    return exact_dedup(docs, keep=["doc_id", "text_sha256"])


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    path = stage_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_digest(read_tokens(spark, path))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "secret_spans")
    number = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.col("secret_spans")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(spans, True), 256).alias("base_sha256"), joined(spans, False).alias("spans"))


def held_out(modulus: int, rest: int):
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(True))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(5, 0)))
    return model.transform(docs.withColumn("held_out", held_out(5, 0))).select("doc_id", "held_out", "score", "predicted")


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(4, 2)).select("text", "lang"))
    texts = docs.select("doc_id", "text").withColumn("held_out", held_out(4, 2))
    return model.transform(texts).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_ngram_jaccard", f"""
WITH RECURSIVE words AS (
    SELECT doc_id, [w FOR w IN string_split_regex({LOWERED}, '[ \t\n\x0B\f\r]+') IF w != ''] AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
        ELSE list_distinct([w[i:i + 4] FOR i IN range(1, len(w) - 3)]) END AS s
    FROM words
), entries AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id != b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS component FROM documents
    UNION
    SELECT links.b, reach.component FROM reach JOIN links ON links.a = reach.node
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.component) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
""")
def op2_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents"))


@query("op8_embedding_dedup", """
WITH RECURSIVE valid AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x != 0]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS component FROM embeddings
    UNION
    SELECT links.b, reach.component FROM reach JOIN links ON links.a = reach.node
)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.component) AS component_id, e.vec_id = min(r.component) AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
GROUP BY e.vec_id
""")
def op8_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by their ids, go on from some word with the same words over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def again(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(words, " ")).otherwise("")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, again)).otherwise(F.col("text")))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed")
    steeper = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.col("best")
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", F.reduce("runs", F.get("runs", F.lit(0)), steeper)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_quality_rules")
def op13_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


#: CRC-32 of a decimal number in SQL.
CRC = """xor(4294967295, list_reduce(list_transform(range(1, len(CAST({0} AS VARCHAR)) + 1), lambda i: ascii(CAST({0} AS VARCHAR)[i])::BIGINT),
    lambda acc, byte: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, byte)), 4294967295))"""


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c with the first turns of conversation c - c % 100, crc32(c) % 6 of them, before its own later ones."""
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    own = in_order(conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL"))
    ids = own.where("d = 1").select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = own.where("d <= 5").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("d", "role", "text"))).alias("turns"))  # five at most
    heads = ids.join(first, "base").select("conv_id", F.explode(F.expr("slice(turns, 1, cast(head AS int))")).alias("t"))
    later = own.where(F.col("d") > head).select("conv_id", F.col("d").alias("turn"), "role", "text")
    return heads.select("conv_id", F.col("t.d").alias("turn"), "t.role", "t.text").unionByName(later), ids.select("conv_id")


@query("op12_prefix_trie", f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), ids AS (
    SELECT conv_id, t, {CRC.format('conv_id')} % 6 AS h FROM own
), built AS (
    SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t FROM ids c LEFT JOIN ids b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
    SELECT conv_id, len(t) AS n, t, unnest(range(0, len(t) + 1)) AS depth FROM built
), placed AS (
    SELECT conv_id, n, depth, t[1:depth] AS path, CASE WHEN depth > 0 THEN t[1:depth - 1] END AS above FROM members
), nodes AS (
    SELECT path, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM placed GROUP BY path
), families AS (
    SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), valued AS (
    SELECT n.*, coalesce(f.n_children, 0) AS n_children,
        CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(n.path[-1].text) END AS saved
    FROM nodes n LEFT JOIN families f ON f.path = n.path
), sums AS (
    SELECT a.path, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM valued v JOIN placed a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.path
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN nodes p ON p.path = v.above
""")
def op12_prefix_trie(spark, sf_dir):
    turns, ids = rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(materialize(turns, "rebuilt"), members=ids)
