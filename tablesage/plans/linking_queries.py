"""Text linked to table values and columns; rankings; context; vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.functions.text import phrases, word_overlap
from tablesage.functions.vectors import cosine, hash_levels, scaled_to_unit
from tablesage.operators import column_ranking, context, literals, profiling, query_logs, value_links
from tablesage.operators.numbering import top_per_group
from tablesage.operators.value_states import ValueStates
from tablesage.plans.inputs import (
    DB, INTENT, LINKED, QLOG, QST, cells_sql, columns_sql, intents, linked_tables, query_log, questions, given, select, spread_table, tables_of,
)
from tablesage.plans.registry import query
from tablesage.session import stable

RAW_PHRASES = """SELECT question_id, db_id, unnest(regexp_extract_all(t, '[''"]([^''"]+)[''"]', 1)) AS p FROM texts
 UNION ALL SELECT question_id, db_id, p FROM (SELECT question_id, db_id, unnest(flatten(list_transform([2, 3, 4], lambda n:
  list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS p FROM
  (SELECT question_id, db_id, regexp_extract_all(t, '\\b[A-Za-z0-9\\-\\.\\,\\(\\)]+\\b') AS w FROM texts))
  WHERE length(p) > 4 AND NOT regexp_matches(lower(p), '^(what is|how many|list the|where is|of the)')""".replace("\\\\", "\\")
PHRASES = f"""texts AS (SELECT question_id, db_id, question || ' ' || evidence AS t FROM ({QST})),
asked AS (SELECT DISTINCT question_id, db_id, trim(p, ' .,''"') AS phrase FROM ({RAW_PHRASES}) WHERE length(trim(p, ' .,''"')) >= 3)"""


@query("link_phrases", f"WITH {PHRASES} SELECT question_id, phrase FROM asked")
def link_phrases(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("question_id", F.explode(phrases(F.col("question"), F.col("evidence"))).alias("phrase"))


def _values(states: ValueStates) -> DataFrame:
    return states.distinct_values().withColumn("db_id", F.lit(DB))


@query("link_values", f"""WITH {PHRASES}, vals AS (SELECT DISTINCT table_name, column_name, ordinal, value FROM ({cells_sql(LINKED)})),
found AS (SELECT p.phrase, table_name, column_name, ordinal, min(value) AS value FROM (SELECT DISTINCT phrase FROM asked) p
 JOIN vals v ON contains(lower(v.value), lower(p.phrase)) GROUP BY ALL),
once AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_name, column_name, value ORDER BY phrase) AS n FROM asked JOIN found USING (phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phrase, table_name, ordinal, value) AS rank FROM once WHERE n = 1)
SELECT question_id, table_name, column_name, phrase, value, CAST(rank AS INT) AS rank,
 'Value ''' || phrase || ''' matches value ''' || value || ''' in table ''' || table_name || ''', column ''' || column_name || '''' AS hint
FROM ranked WHERE rank <= 10""")
def link_values(spark, sf_dir):
    tables = tables_of(spark, sf_dir, LINKED)
    columns = profiling.column_metadata(spark, tables, DB)
    values = _values(ValueStates(tables))
    return value_links.link_values(questions(spark, sf_dir), values, columns).drop("db_id")


# Letters beyond ASCII are blanks in these questions: SQL engines differ in where words end beside them.
BENCH_QST = "SELECT CAST(item_id AS STRING) AS question_id, 'corpus' AS db_id, regexp_replace(text, '[^ -~]', ' '{}) AS question, '' AS evidence FROM benchmark"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("link_documents", f"""WITH {PHRASES.replace(QST, BENCH_QST.format(", 'g'"))},
found AS (SELECT needle, min(text) AS value FROM (SELECT DISTINCT {LOWER.format('phrase')} AS needle FROM asked) p
 JOIN documents d ON contains({LOWER.format('d.text')}, p.needle) GROUP BY needle),
once AS (SELECT *, row_number() OVER (PARTITION BY question_id, value ORDER BY phrase) AS n FROM asked JOIN found ON needle = {LOWER.format('phrase')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phrase, value) AS rank FROM once WHERE n = 1)
SELECT question_id, phrase, CAST(rank AS INT) AS rank, sha256(value) AS value_sha256 FROM ranked WHERE rank <= 10""")
def link_documents(spark, sf_dir):
    """Which passages of the corpus do the benchmark's items mention? Whole documents are the values."""
    q = select(spark, sf_dir, BENCH_QST.format(""), ["benchmark"])
    where = [F.lit("corpus").alias("db_id"), F.lit("documents").alias("table_name"), F.lit("text").alias("column_name")]
    values = spread_table(spark, sf_dir, "documents").select(*where, F.col("text").alias("value"))
    columns = values.limit(1).select("db_id", "table_name", "column_name", F.lit(0).alias("ordinal"))
    links = value_links.link_values(q, values, columns)
    return links.select("question_id", "phrase", "rank", F.sha2("value", 256).alias("value_sha256"))


TYPO_LITERALS = """SELECT CAST(p_partkey AS STRING) AS question_id, 'tpch' AS db_id, concat(substr(p_name, 1, 2), 'x', substr(p_name, 4)) AS literal FROM part
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 'tpch', lower(c_mktsegment) FROM customer"""


def _typo_literals(spark, sf_dir):
    return select(spark, sf_dir, TYPO_LITERALS, ["part", "customer"])


@query("link_literals_fuzzy")
def link_literals_fuzzy(spark, sf_dir):
    profiles = profiling.profile_tables(tables_of(spark, sf_dir, LINKED), DB)
    return literals.fuzzy_literal_matches(_typo_literals(spark, sf_dir), literals.frequent_values(profiles))


TOP_VALUES = f"""top AS (SELECT table_name, column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS n
 FROM (SELECT table_name, column_name, value, count(*) AS cnt FROM ({cells_sql(LINKED)}) WHERE value IS NOT NULL GROUP BY ALL)) WHERE n <= 20)"""


@query("link_literals_exact", f"""WITH {TOP_VALUES}
SELECT question_id, literal, table_name, column_name, value AS matched_value FROM ({TYPO_LITERALS}) JOIN top ON lower(literal) = lower(value)""")
def link_literals_exact(spark, sf_dir):
    top = profiling.top_values(ValueStates(tables_of(spark, sf_dir, LINKED)))
    values = literals.frequent_values(top.withColumn("db_id", F.lit(DB)))
    matches = literals.exact_literal_matches(_typo_literals(spark, sf_dir), values)
    return matches.select("question_id", "literal", "table_name", "column_name", "matched_value")


@query("retrieve_columns")
def retrieve_columns(spark, sf_dir):
    profiles = profiling.profile_tables(tables_of(spark, sf_dir, LINKED), DB)
    found = column_ranking.retrieve_columns(intents(spark, sf_dir), profiles)
    return found.select("question_id", "table_name", "column_name", F.round("semantic_score", 6).alias("semantic_score"))


def words_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(trim(replace(lower({text}), '_', ' ')), '\\s+'), lambda w: w <> ''))"


def overlap_sql(a: str, b: str) -> str:
    wa, wb = words_sql(a), words_sql(b)
    return f"CASE WHEN len({wa}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({wa}, {wb}))::DOUBLE / len({wa}) END"


@query("text_overlap", f"""SELECT question_id, round({overlap_sql('question', 'evidence')}, 6) AS question_in_evidence,
 round({overlap_sql('evidence', 'question')}, 6) AS evidence_in_question FROM ({QST})""")
def text_overlap(spark, sf_dir):
    q, e = F.col("question"), F.col("evidence")
    return questions(spark, sf_dir).select(
        "question_id", F.round(word_overlap(q, e), 6).alias("question_in_evidence"), F.round(word_overlap(e, q), 6).alias("evidence_in_question")
    )


# The share of the wording found in the column's text stands in for the fuzzy score here, which SQL cannot state.
FEATURES = f"""{TOP_VALUES}, prof AS (SELECT c.*, d.distinct_count FROM ({columns_sql(LINKED)}) c
  JOIN (SELECT table_name, column_name, count(DISTINCT value) AS distinct_count FROM ({cells_sql(LINKED)}) GROUP BY ALL) d USING (table_name, column_name)),
log_cols AS (SELECT lower(array_to_string(list_distinct(regexp_extract_all(sql, '\\b[a-z]\\.[a-z]_\\w+')), ' ')) AS cols FROM ({QLOG})),
support AS (SELECT column_name, avg(contains(cols, lower(column_name))::INT) AS query_log_support FROM (SELECT DISTINCT column_name FROM prof), log_cols GROUP BY ALL),
intents AS ({INTENT}),
hits AS (SELECT DISTINCT question_id, table_name, column_name FROM (SELECT question_id, unnest([literal_1, literal_2]) AS literal FROM intents)
 JOIN top ON lower(literal) = lower(value)),
feats AS (SELECT i.question_id, p.table_name, p.column_name,
 {overlap_sql("output_phrase || ' ' || filter_text || ' ' || literal_1 || ' ' || literal_2", "p.table_name || ' ' || p.column_name")} AS semantic_score,
 CASE WHEN h.question_id IS NULL THEN 0 ELSE 1 END AS literal_match,
 {overlap_sql('output_phrase', "p.table_name || ' ' || p.column_name")} AS output_match,
 {overlap_sql('filter_text', "p.table_name || ' ' || p.column_name")} AS filter_match,
 CAST(contains(p.column_name, 'id') AS INT) AS is_id_like, CAST(contains(p.column_name, 'date') AS INT) AS is_date_like,
 CAST(data_type IN ('int', 'bigint', 'double') AS INT) AS is_numeric_like, 0.0::DOUBLE AS null_ratio, distinct_count, query_log_support
 FROM intents i CROSS JOIN prof p JOIN support s ON s.column_name = p.column_name
 LEFT JOIN hits h ON h.question_id = i.question_id AND h.table_name = p.table_name AND h.column_name = p.column_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance_score DESC, table_name, column_name) AS rank FROM
 (SELECT *, 0.0::DOUBLE + 0.3::DOUBLE * semantic_score + 0.25::DOUBLE * literal_match + 0.2::DOUBLE * output_match + 0.15::DOUBLE * filter_match
  + 0.1::DOUBLE * query_log_support AS relevance_score FROM feats))""".replace("\\\\", "\\")


def _matches(spark, sf_dir, profiles):
    used = intents(spark, sf_dir).select("question_id", "db_id", F.explode("literals").alias("literal"))
    return literals.exact_literal_matches(used, literals.frequent_values(profiles))


def _features(spark, sf_dir):
    tables = tables_of(spark, sf_dir, LINKED)
    # Profiles are made once and used by several steps.
    states = ValueStates(tables)
    profiles = stable(profiling.profile_tables(tables, DB, states=states))
    retrieved = column_ranking.retrieve_columns(intents(spark, sf_dir), profiles, similarity=column_ranking.WORDS)
    columns = profiling.column_metadata(spark, tables, DB).select("table_name", "column_name")
    support = query_logs.column_log_support(columns, query_log(spark, sf_dir))
    return column_ranking.column_features(retrieved, _matches(spark, sf_dir, profiles), support), profiles, states


@query("column_features", f"""WITH {FEATURES} SELECT question_id, table_name, column_name, round(semantic_score, 6) AS semantic_score, literal_match,
 round(output_match, 6) AS output_match, round(filter_match, 6) AS filter_match, is_id_like, is_date_like, is_numeric_like, null_ratio, distinct_count,
 round(query_log_support, 6) AS query_log_support FROM feats""")
def column_features(spark, sf_dir):
    rounded = {c: F.round(c, 6) for c in ("semantic_score", "output_match", "filter_match", "query_log_support")}
    return _features(spark, sf_dir)[0].withColumns(rounded).drop("db_id")


@query("rank_columns", f"""WITH {FEATURES} SELECT question_id, table_name, column_name, round(relevance_score, 6) AS relevance_score, CAST(rank AS INT) AS rank FROM ranked""")
def rank_columns(spark, sf_dir):
    ranked = column_ranking.rank_by_rule(_features(spark, sf_dir)[0])
    return ranked.select("question_id", "table_name", "column_name", F.round("relevance_score", 6).alias("relevance_score"), "rank")


@query("rank_columns_ml")
def rank_columns_ml(spark, sf_dir):
    features = stable(_features(spark, sf_dir)[0])
    labeled = features.withColumn("label", (F.col("literal_match") == 1).cast("double"))
    ranked = column_ranking.ColumnRanker().fit(labeled).rank(features)
    return ranked.select("question_id", "table_name", "column_name", F.round("relevance_score", 6).alias("relevance_score"), "rank")


@query("qlog_support", f"""WITH log_cols AS (SELECT lower(array_to_string(list_distinct(regexp_extract_all(sql, '\\b[a-z]\\.[a-z]_\\w+')), ' ')) AS cols FROM ({QLOG}))
SELECT table_name, column_name, round(avg(contains(cols, lower(column_name))::INT), 6) AS query_log_support FROM ({columns_sql(LINKED)}), log_cols GROUP BY ALL""".replace("\\\\", "\\"))
def qlog_support(spark, sf_dir):
    columns = profiling.column_metadata(spark, linked_tables(spark, sf_dir), DB).select("table_name", "column_name")
    support = query_logs.column_log_support(columns, query_log(spark, sf_dir))
    return support.withColumn("query_log_support", F.round("query_log_support", 6))


@query("context_tables", f"""WITH {FEATURES} SELECT question_id, table_name, CAST(min(rank) AS INT) AS position, round(arg_min(relevance_score, rank), 6) AS score
FROM ranked WHERE rank <= 30 GROUP BY question_id, table_name""")
def context_tables(spark, sf_dir):
    found = context.context_tables(column_ranking.rank_by_rule(_features(spark, sf_dir)[0]))
    return found.withColumn("score", F.round("score", 6))


@query("context_package", f"""WITH {FEATURES}, lists AS (SELECT question_id, string_agg(table_name || '.' || column_name, ',' ORDER BY rank) AS top_columns,
 max(relevance_score) AS schema_linking FROM ranked WHERE rank <= 30 GROUP BY question_id),
tabs AS (SELECT question_id, string_agg(table_name, ',' ORDER BY position) AS top_tables FROM
 (SELECT question_id, table_name, min(rank) AS position FROM ranked WHERE rank <= 30 GROUP BY ALL) GROUP BY question_id),
{PHRASES}, vals AS (SELECT DISTINCT table_name, column_name, ordinal, value FROM ({cells_sql(LINKED)})),
found AS (SELECT p.phrase, table_name, column_name, ordinal, min(value) AS value FROM (SELECT DISTINCT phrase FROM asked) p
 JOIN vals v ON contains(lower(v.value), lower(p.phrase)) GROUP BY ALL),
hints AS (SELECT question_id, least(count(DISTINCT (table_name, column_name, value)), 10) AS n FROM asked JOIN found USING (phrase) GROUP BY question_id)
SELECT q.question_id, q.db_id, q.question, q.evidence, top_columns, top_tables, CAST(coalesce(n, 0) AS INT) + 1 AS num_constraints,
 round(schema_linking, 6) AS schema_linking, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.question_id = q.question_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS literal_mapping,
 round(1.0::DOUBLE / (coalesce(n, 0) + 1), 6) AS evidence_parsing
FROM ({QST}) q JOIN lists USING (question_id) JOIN tabs USING (question_id) LEFT JOIN hints USING (question_id)""")
def context_package(spark, sf_dir):
    features, profiles, states = _features(spark, sf_dir)
    q = questions(spark, sf_dir)
    links = value_links.link_values(q, _values(states), profiles)
    # The evidence of these questions states one mapping each; it is taken as parsed with full confidence.
    parsed = q.select(
        "question_id",
        F.array(
            F.struct(
                F.lit("part.p_type").alias("column"), F.lit("=").alias("operator"),
                F.regexp_extract("evidence", "'([^']*)'", 1).alias("value"), F.lit(1.0).alias("confidence"), F.lit(False).alias("parse_error"),
            )
        ).alias("constraints"),
    )
    constraints = context.merge_constraints(value_links.value_constraints(links), parsed)
    package = context.context_package(
        q, column_ranking.rank_by_rule(features), _matches(spark, sf_dir, profiles), constraints
    )
    return package.select(
        "question_id", "db_id", "question", "evidence",
        F.array_join(F.transform("top_columns", lambda c: F.concat_ws(".", c["table_name"], c["column_name"])), ",").alias("top_columns"),
        F.array_join("top_tables.table", ",").alias("top_tables"), F.size("evidence_constraints").alias("num_constraints"),
        F.round("confidence.schema_linking", 6).alias("schema_linking"), "confidence.literal_mapping",
        F.round("confidence.evidence_parsing", 6).alias("evidence_parsing"),
    )


@query("cosine_pairs", """SELECT a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = given(spark, sf_dir)["embeddings"]
    a = e.select("vec_id", F.col("embedding").alias("a"), (F.col("vec_id") + 1).alias("next_id"))
    b = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, "next_id").select("vec_id", "next_id", F.round(cosine(F.col("a"), F.col("b")), 5).alias("similarity"))


@query("cosine_topk", """WITH dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
means AS (SELECT label, list(m ORDER BY d) AS center FROM (SELECT label, d, avg(x) AS m FROM dims GROUP BY label, d) GROUP BY label),
scored AS (SELECT e.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], center) AS s FROM embeddings e JOIN means m ON e.label = m.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM scored)
SELECT label, vec_id, CAST(rank AS INT) AS rank, round(s, 5) AS similarity FROM ranked WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = given(spark, sf_dir)["embeddings"]
    means = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("center")
    )
    scored = e.join(centers, "label").select("label", "vec_id", cosine(F.col("embedding"), F.col("center")).alias("s"))
    best = top_per_group(scored, ["label"], [F.round("s", 9).desc(), F.col("vec_id")], 5)
    return best.select("label", "vec_id", "rank", F.round("s", 5).alias("similarity"))


@query("hash_embedding", """WITH h AS (SELECT doc_id, sha256(text) AS hex FROM documents),
b AS (SELECT doc_id, list_transform(range(0, 32), lambda i: CAST('0x' || substr(hex, CAST(2 * i + 1 AS INT), 2) AS INT)) AS bytes FROM h),
l AS (SELECT doc_id, list_transform(range(0, 1536), lambda i: (bytes[CAST(i % 32 + 1 AS INT)] * (i + 1)) % 100) AS levels FROM b),
n AS (SELECT doc_id, levels, sqrt(list_sum(list_transform(levels, lambda v: (v / 100.0::DOUBLE) * (v / 100.0::DOUBLE)))) AS len FROM l)
SELECT doc_id, CAST(len(levels) AS INT) AS dimensions, CAST(list_sum(levels) AS BIGINT) AS level_sum,
 round(levels[1] / 100.0::DOUBLE / len, 8) AS first, round(levels[1536] / 100.0::DOUBLE / len, 8) AS last FROM n""")
def hash_embedding(spark, sf_dir):
    levels = hash_levels(F.col("text"))
    d = spread_table(spark, sf_dir, "documents").select("doc_id", levels.alias("levels"))
    d = d.withColumn("v", scaled_to_unit(F.transform("levels", lambda x: x / F.lit(100.0))))
    return d.select(
        "doc_id", F.size("v").alias("dimensions"),
        F.aggregate("levels", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("level_sum"),
        F.round(F.element_at("v", 1), 8).alias("first"), F.round(F.element_at("v", -1), 8).alias("last"),
    )


@query("question_tables", f"""WITH {FEATURES}, tabs AS (SELECT question_id, table_name, min(rank) AS position, arg_min(relevance_score, rank) AS score FROM ranked WHERE rank <= 30 GROUP BY question_id, table_name),
{PHRASES}, vals AS (SELECT DISTINCT table_name, column_name, ordinal, value FROM ({cells_sql(LINKED)})),
found AS (SELECT p.phrase, table_name, column_name, ordinal, min(value) AS value FROM (SELECT DISTINCT phrase FROM asked) p
 JOIN vals v ON contains(lower(v.value), lower(p.phrase)) GROUP BY ALL),
once AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_name, column_name, value ORDER BY phrase) AS n FROM asked JOIN found USING (phrase)),
hints AS (SELECT question_id, table_name, count(*) AS value_hints FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phrase, table_name, ordinal, value) AS r FROM once WHERE n = 1) WHERE r <= 10 GROUP BY ALL)
SELECT question_id, table_name, CAST(position AS INT) AS position, round(score, 6) AS score, coalesce(value_hints, 0) AS value_hints FROM tabs LEFT JOIN hints USING (question_id, table_name)""")
def question_tables(spark, sf_dir):
    """The flagship: which tables does each question need, and how many of its words are values in them?"""
    features, profiles, states = _features(spark, sf_dir)
    tables = context.context_tables(column_ranking.rank_by_rule(features))
    links = value_links.link_values(questions(spark, sf_dir), _values(states), profiles)
    hints = links.groupBy("question_id", "table_name").agg(F.count(F.lit(1)).alias("value_hints"))
    return tables.join(hints, ["question_id", "table_name"], "left").select(
        "question_id", "table_name", "position", F.round("score", 6).alias("score"), F.coalesce("value_hints", F.lit(0)).alias("value_hints")
    )
