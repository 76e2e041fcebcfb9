"""Training sets and learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesage.operators import profiling, query_logs, training_sets
from tablesage.operators.numbering import Along
from tablesage.operators.preference import PreferenceModel
from tablesage.plans.inputs import (
    CAND, COLUMNS, DB, LINKED, QLOG, QST, candidates, cells_sql, columns_sql, given, linked_tables, query_log_by_row, questions, select,
    unnumbered_candidates,
)
from tablesage.plans.registry import ORACLES, query
from tablesage.session import stable

SCORE_SQL = "CASE WHEN is_correct THEN 2.0::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - runtime_sec / 10.0::DOUBLE)) WHEN success AND row_count > 0 THEN 1.5::DOUBLE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("candidate_scores", f"SELECT question_id, candidate_id, round({SCORE_SQL}, 6) AS score FROM ({CAND})")
def candidate_scores(spark, sf_dir):
    rows = training_sets.with_quality_score(unnumbered_candidates(spark, sf_dir))
    return rows.select("question_id", "candidate_id", F.round("score", 6).alias("score"))


@query("rollout_rewards", f"""SELECT question_id, db_id, candidate_id, CASE WHEN is_correct THEN 1.0::DOUBLE WHEN NOT success THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS reward FROM ({CAND})""")
def rollout_rewards(spark, sf_dir):
    return training_sets.rollout_rewards(unnumbered_candidates(spark, sf_dir))


@query("listwise_rows", f"""WITH cand AS ({CAND}) SELECT question_id, CAST(floor(pos / 1000) AS INT) AS part, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY pos) AS candidates,
 coalesce(any_value(best), -1) AS best_candidate_id FROM cand LEFT JOIN (SELECT question_id, arg_min(candidate_id, (runtime_sec, pos)) AS best FROM cand WHERE is_correct GROUP BY question_id) USING (question_id)
 GROUP BY question_id, part""")
def listwise_rows(spark, sf_dir):
    rows = training_sets.listwise_rows(candidates(spark, sf_dir), ["candidate_id", "source"])
    ids = F.array_join(F.transform("candidates", lambda c: c["candidate_id"].cast("string")), ",")
    return rows.select("question_id", "part", ids.alias("candidates"), F.coalesce("best_candidate_id", F.lit(-1)).alias("best_candidate_id"))


DRAWN = f"""cand AS ({CAND}), scored AS (SELECT *, {SCORE_SQL} AS score FROM cand),
counts AS (SELECT question_id, count(*) * (count(*) - 1) // 2 AS pairs FROM cand GROUP BY question_id HAVING count(*) > 1),
draws AS (SELECT question_id, pairs, least(pairs, 20) AS draws, unnest(range(0, least(pairs, 20))) AS draw FROM counts),
bounds AS (SELECT *, draw * pairs // draws AS low, (draw + 1) * pairs // draws AS high FROM draws),
numbers AS (SELECT question_id, draw, low + CAST('0x' || substr(md5(question_id || '#' || draw || '#0'), 1, 8) AS BIGINT) % (high - low) AS number FROM bounds),
numbered AS (SELECT a.question_id, a.pos AS pos_a, b.pos AS pos_b, a.score AS score_a, b.score AS score_b, row_number() OVER (PARTITION BY a.question_id ORDER BY b.pos, a.pos) - 1 AS number,
 a.candidate_id AS a_candidate_id, b.candidate_id AS b_candidate_id, a.source AS source_a, b.source AS source_b FROM scored a JOIN scored b ON a.question_id = b.question_id AND a.pos < b.pos)"""


@query("pairwise_rows", f"""WITH {DRAWN} SELECT question_id, CAST(draw AS INT) AS draw, a_candidate_id, b_candidate_id,
 CASE WHEN score_a = score_b THEN 'tie' WHEN score_a > score_b THEN 'A' ELSE 'B' END AS winner, CASE WHEN score_a = score_b THEN 'tie' WHEN score_a > score_b THEN 'B' ELSE 'A' END AS rejected
 FROM numbers JOIN numbered USING (question_id, number)""")
def pairwise_rows(spark, sf_dir):
    rows = training_sets.pairwise_rows(candidates(spark, sf_dir), ["candidate_id"])
    return rows.select("question_id", "draw", "a_candidate_id", "b_candidate_id", "winner", "rejected")


@query("pairwise_train_text", f"""WITH {DRAWN} SELECT question_id, CAST(draw AS INT) AS draw, concat('Question:', chr(10), 'q', question_id, chr(10), chr(10), 'Evidence:', chr(10), '', chr(10), chr(10),
 'SQL A:', chr(10), 'SELECT ', source_a, chr(10), chr(10), 'Execution A:', chr(10), 'success=', a.success, ', rows=', coalesce(CAST(a.row_count AS VARCHAR), 'None'), ', error=', coalesce(a.error, 'None'), chr(10), chr(10),
 'SQL B:', chr(10), 'SELECT ', source_b, chr(10), chr(10), 'Execution B:', chr(10), 'success=', b.success, ', rows=', coalesce(CAST(b.row_count AS VARCHAR), 'None'), ', error=', coalesce(b.error, 'None'), chr(10), chr(10),
 'Which SQL is better? Answer A, B, or tie.') AS prompt
 FROM numbers JOIN numbered n USING (question_id, number) JOIN cand a ON a.question_id = n.question_id AND a.pos = pos_a JOIN cand b ON b.question_id = n.question_id AND b.pos = pos_b""".replace("SELECT question_id, CAST(draw", "SELECT n.question_id AS question_id, CAST(draw").replace("'q', question_id", "'q', n.question_id"))
def pairwise_train_text(spark, sf_dir):
    fields = ["source", "success", "row_count", "error"]
    rows = training_sets.pairwise_rows(candidates(spark, sf_dir), fields)
    sides = {
        name: {
            "sql": F.concat(F.lit("SELECT "), f"{p}_source"), "success": F.col(f"{p}_success"),
            "row_count": F.col(f"{p}_row_count"), "error": F.col(f"{p}_error"),
        }
        for name, p in (("A", "a"), ("B", "b"))
    }
    text = training_sets.pair_prompt(F.concat(F.lit("q"), F.col("question_id").cast("string")), F.lit(""), sides)
    return rows.select("question_id", "draw", text.alias("prompt"))


GOLD = """SELECT question_id, result_key || '!' AS gold_key, row_count AS gold_rows, column_count AS gold_columns FROM (SELECT *, row_number() OVER (PARTITION BY question_id
 ORDER BY runtime_sec, pos) AS r FROM cand WHERE is_correct) WHERE r = 1"""
LABELED = f"""cand AS ({CAND}), gold AS ({GOLD}), labeled AS (SELECT c.*, CASE WHEN NOT success THEN 0 WHEN is_correct THEN 2
 WHEN row_count = gold_rows AND column_count = gold_columns THEN 1 ELSE 0 END AS label FROM cand c JOIN gold USING (question_id))"""


def _labeled(spark, sf_dir):
    """Candidates against the fastest correct one of their question; correct candidates share a result with it."""
    rows = candidates(spark, sf_dir).withColumn(
        "result_key", F.when(F.col("is_correct"), F.lit("gold")).otherwise(F.col("result_key"))
    )
    best = rows.filter("is_correct").groupBy("question_id").agg(F.min_by(F.struct("row_count", "column_count"), F.struct("runtime_sec", "pos")).alias("g"))
    gold = best.select("question_id", F.lit("gold").alias("gold_key"), F.col("g.row_count").alias("gold_rows"), F.col("g.column_count").alias("gold_columns"))
    return training_sets.label_candidates(rows, gold)


@query("candidate_labels", f"WITH {LABELED} SELECT question_id, candidate_id, label FROM labeled")
def candidate_labels(spark, sf_dir):
    return _labeled(spark, sf_dir).select("question_id", "candidate_id", "label")


@query("preference_pairs", f"""WITH {LABELED}, pairs AS (SELECT a.question_id, a.label AS la, a.source AS sa, a.pos AS pa, b.label AS lb, b.source AS sb, b.pos AS pb,
 a.candidate_id AS ca, b.candidate_id AS cb FROM labeled a JOIN labeled b ON a.question_id = b.question_id AND a.pos < b.pos),
firsts AS (SELECT question_id, label, source, min(pos) AS first_pos, max(pos) AS last_pos FROM labeled GROUP BY ALL),
sided AS (SELECT p.question_id, CASE WHEN fa.first_pos <= fb.first_pos THEN la ELSE lb END AS label_a, CASE WHEN fa.first_pos <= fb.first_pos THEN sa ELSE sb END AS source_a,
 CASE WHEN fa.first_pos <= fb.first_pos THEN lb ELSE la END AS label_b, CASE WHEN fa.first_pos <= fb.first_pos THEN sb ELSE sa END AS source_b FROM pairs p
 JOIN firsts fa ON fa.question_id = p.question_id AND fa.label = la AND fa.source = sa JOIN firsts fb ON fb.question_id = p.question_id AND fb.label = lb AND fb.source = sb),
counted AS (SELECT question_id, label_a, source_a, label_b, source_b, count(*) AS n_pairs FROM sided GROUP BY ALL)
SELECT c.question_id, label_a, source_a, label_b, source_b, n_pairs, fa.first_pos AS pos_a, CASE WHEN label_a = label_b AND source_a = source_b THEN fb.last_pos ELSE fb.first_pos END AS pos_b,
 CASE WHEN label_a = label_b THEN 'tie' WHEN label_a > label_b THEN 'A' ELSE 'B' END AS winner FROM counted c
 JOIN firsts fa ON fa.question_id = c.question_id AND fa.label = label_a AND fa.source = source_a JOIN firsts fb ON fb.question_id = c.question_id AND fb.label = label_b AND fb.source = source_b""")
def preference_pairs(spark, sf_dir):
    return training_sets.preference_pairs(_labeled(spark, sf_dir)).select(
        "question_id", "label_a", "source_a", "label_b", "source_b", "n_pairs", "pos_a", "pos_b", "winner"
    )


@query("preference_rows", f"""WITH {LABELED}, ranked AS (SELECT question_id, candidate_id, pos, label, source, row_number() OVER (PARTITION BY question_id, label, source ORDER BY pos) - 1 AS r,
 count(*) OVER (PARTITION BY question_id, label, source) AS n FROM labeled),
sized AS (SELECT a.*, b.label AS tl, b.source AS ts, b.n AS m, a.label = b.label AND a.source = b.source AS own, CASE WHEN a.label = b.label AND a.source = b.source THEN (a.n - 1) // 2 ELSE b.n END AS h
 FROM ranked a JOIN (SELECT DISTINCT question_id, label, source, n FROM ranked) b ON a.question_id = b.question_id AND (b.n < a.n OR b.n = a.n AND (b.label < a.label OR b.label = a.label AND b.source <= a.source))),
drawn AS (SELECT *, least(2, h) AS c, own AND n % 2 = 0 AND h < 2 AS half FROM sized),
draws AS (SELECT *, unnest(range(0, c + CASE WHEN half AND r < n // 2 THEN 1 ELSE 0 END)) AS j FROM drawn),
steps AS (SELECT *, CASE WHEN j = c THEN n // 2 ELSE own::INT + j * h // c + CAST('0x' || substr(md5(question_id || '#' || label || '#' || source || '#' || tl || '#' || ts || '#' || j || '#0'), 1, 8) AS BIGINT)
 % ((j + 1) * h // c - j * h // c) END AS step FROM draws)
SELECT s.question_id, CASE WHEN s.pos < p.pos THEN s.candidate_id ELSE p.candidate_id END AS candidate_a, CASE WHEN s.pos < p.pos THEN p.candidate_id ELSE s.candidate_id END AS candidate_b,
 round(CASE WHEN own THEN s.n * (s.n - 1) / 2 / (s.n * c + CASE WHEN half THEN s.n // 2 ELSE 0 END) ELSE m / c END, 6) AS n_pairs,
 CASE WHEN s.label = p.label THEN 'tie' WHEN (s.label > p.label) = (s.pos < p.pos) THEN 'A' ELSE 'B' END AS winner
FROM steps s JOIN ranked p ON p.question_id = s.question_id AND p.label = tl AND p.source = ts AND p.r = (s.r + step) % m""")
def preference_rows(spark, sf_dir):
    rows = training_sets.preference_rows(_labeled(spark, sf_dir))
    return rows.select("question_id", "candidate_a", "candidate_b", F.round("n_pairs", 6).alias("n_pairs"), "winner")


# Contexts of the candidates' questions, longer than the compact form allows.
CONTEXTS = """SELECT CAST(c_custkey AS BIGINT) AS question_id, 'tpch' AS db_id, concat('What does ', c_name, ' owe?') AS question, concat('segment ', c_mktsegment) AS evidence,
 c_nationkey AS extra FROM customer"""


@query("preference_contexts", f"""SELECT p.*, db_id, question, evidence,
 array_to_string(list_transform(range(1, least(20 + extra, 30) + 1), lambda i: 't.c' || i), ',') AS top_columns, 'name -> ' || question AS matched,
 array_to_string(list_transform(range(1, least(1 + extra, 10) + 1), lambda i: 'a.k' || i || ' = b.k' || i), ',') AS top_joins,
 array_to_string(list_transform(range(1, least(extra % 12, 10) + 1), lambda i: 'rule ' || i), ',') AS business_rules
FROM ({ORACLES['preference_rows']}) p JOIN ({CONTEXTS}) c USING (question_id)""")
def preference_contexts(spark, sf_dir):
    """Training pairs with the question and its compact context."""
    numbered_texts = lambda n, text: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.replace(F.lit(text), F.lit("#"), i.cast("string")))
    extra = F.col("extra").cast("int")
    contexts = select(spark, sf_dir, CONTEXTS, ["customer"]).select(
        "question_id", "db_id", "question", "evidence", numbered_texts(20 + extra, "t.c#").alias("columns"), F.array(F.concat(F.lit("name -> "), "question")).alias("matched"),
        F.array().cast("array<string>").alias("constraints"), numbered_texts(1 + extra, "a.k# = b.k#").alias("joins"), numbered_texts(extra % 12, "rule #").alias("rules"),
    )
    rows = training_sets.with_context(training_sets.preference_rows(_labeled(spark, sf_dir)), contexts, lambda x: F.array_join(x, ","))
    lists = [F.col(f"context.{c}") for c in ("top_columns", "matched", "top_joins", "business_rules")]
    return rows.select("question_id", "candidate_a", "candidate_b", F.round("n_pairs", 6).alias("n_pairs"), "winner", "db_id", "question", "evidence", *lists)


@query("preference_model")
def preference_model(spark, sf_dir):
    fields = ["candidate_id", "source", "success", "row_count", "column_count", "num_repairs"]
    pairs = stable(training_sets.pairwise_rows(candidates(spark, sf_dir), fields))
    split = training_sets.hash_split(pairs)
    model = PreferenceModel().fit(split.filter("split = 'train'"))
    judged = model.judge(split)
    return judged.select("question_id", "split", "a_candidate_id", "b_candidate_id", "winner", F.round("confidence", 4).alias("confidence"))


@query("train_dev_split", f"""SELECT question_id, candidate_id, CASE WHEN row_number() OVER (ORDER BY candidate_id) - 1 < (SELECT CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) FROM events) THEN 'train' ELSE 'dev' END AS split,
 CASE WHEN CAST('0x' || substr(md5(question_id || '#0'), 1, 8) AS BIGINT) % 1000 < 100 THEN 'dev' ELSE 'train' END AS question_split FROM ({CAND})""")
def train_dev_split(spark, sf_dir):
    rows = unnumbered_candidates(spark, sf_dir).select("question_id", "candidate_id")
    by_question = training_sets.hash_split(rows).withColumnRenamed("split", "question_split")
    return training_sets.positional_split(by_question, [Along(F.col("candidate_id"))])


RANKER_SQL = rf"""WITH top AS (SELECT table_name, column_name, lower(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS n
 FROM (SELECT table_name, column_name, value, count(*) AS cnt FROM ({cells_sql(LINKED)}) WHERE value IS NOT NULL GROUP BY ALL)) WHERE n <= 20),
log AS (SELECT question_id, sql, list_distinct(list_filter(string_split_regex(lower(sql), '\s+'), lambda w: w <> '')) AS words,
 list_transform(regexp_extract_all(sql, '''[A-Z]''|[ ]\d+'), lambda v: lower(trim(v, ' '''))) AS lits, regexp_extract_all(sql, '(?:FROM|JOIN) (\w+)', 1) AS tabs,
 list_transform(regexp_extract_all(sql, '\b[a-z]\.[a-z]_\w+'), lambda c: substr(c, 3)) AS cols FROM ({QLOG})),
cols AS ({columns_sql(LINKED)}), vals AS (SELECT table_name, column_name, list(v) AS vs FROM top GROUP BY ALL)
SELECT question_id, c.table_name || '.' || c.column_name AS candidate, round(len(list_intersect(words, list_distinct(string_split(c.column_name, '_'))))::DOUBLE / len(list_distinct(string_split(c.column_name, '_'))), 4) AS name_overlap,
 CAST(list_has_any(lits, vs) AS INT) AS literal_exact_match, CAST(data_type = 'string' AS INT) AS profile_type_match,
 CASE WHEN list_contains(cols, c.column_name) THEN 2 WHEN list_contains(tabs, c.table_name) THEN 1 ELSE 0 END AS label
FROM log CROSS JOIN cols c JOIN vals USING (table_name, column_name)"""


def _ranker_rows(spark, sf_dir, fuzzy):
    profiles = profiling.profile_tables(linked_tables(spark, sf_dir), DB)
    log = query_log_by_row(spark, sf_dir)
    asked = log.select("question_id", F.lit(DB).alias("db_id"), F.col("sql").alias("question"))
    return training_sets.ranker_rows(query_logs.clause_roles(log), asked, profiles, fuzzy)


@query("ranker_train_labels", RANKER_SQL)
def ranker_train_labels(spark, sf_dir):
    return _ranker_rows(spark, sf_dir, False).select(
        "question_id", "candidate", "name_overlap", "literal_exact_match", "profile_type_match", "label"
    )


@query("ranker_train_fuzzy")
def ranker_train_fuzzy(spark, sf_dir):
    return _ranker_rows(spark, sf_dir, True).select(
        "question_id", "candidate", "semantic_sim_question_column", "literal_fuzzy_match", "label"
    )


def _plain_ddl_sql() -> str:
    texts = []
    for t in sorted(LINKED):
        lines = ",\n".join(f'  "{c}" {k}' for c, k in COLUMNS[t])
        texts.append(f"CREATE TABLE {t} (\n{lines}\n);")
    return "\n".join(texts).replace("'", "''")


@query("sft_rows", f"""SELECT question_id, '{training_sets.SFT_SYSTEM}' AS system, concat('Question:', chr(10), question, chr(10), chr(10), 'Evidence:', chr(10), evidence, chr(10), chr(10), 'Schema:', chr(10), '{_plain_ddl_sql()}') AS "user",
 concat('SELECT ', question_id) AS assistant FROM ({QST})""")
def sft_rows(spark, sf_dir):
    profiles = profiling.column_metadata(spark, linked_tables(spark, sf_dir), DB)
    ddl = profiling.database_schema_text(profiling.plain_schema_text(profiles), "\n")
    samples = questions(spark, sf_dir).withColumn("SQL", F.concat(F.lit("SELECT "), "question_id"))
    rows = training_sets.chat_sft_rows(samples, ddl)
    return rows.select("question_id", *[F.col("messages").getItem(i).getField("content").alias(n) for i, n in enumerate(["system", "user", "assistant"])])


@query("chat_rows", """SELECT conv_id, CAST(floor(turn / 1000) AS INT) AS part, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id, part""")
def chat_rows(spark, sf_dir):
    rows = training_sets.chat_rows(given(spark, sf_dir)["conversations"])
    return rows.select("conv_id", "part", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))
