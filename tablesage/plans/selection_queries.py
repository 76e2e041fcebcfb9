"""Batches of queries run, compared and judged; candidates grouped, ranked and selected."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesage.functions.digest import result_summary
from tablesage.operators import batch, compare, hard_cases, selection
from tablesage.operators.value_states import unite
from tablesage.plans.inputs import CAND, COLUMNS, STAR, candidates, given, tables_of
from tablesage.plans.registry import query
from tablesage.session import stable

# Candidate texts for the batch: the shapes that occur in practice, two of them broken, one forbidden.
BATCH = {
    "scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "join": "SELECT c.c_name, o.o_totalprice FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey",
    "group": "SELECT n.n_name, COUNT(*) AS n FROM supplier AS s JOIN nation AS n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "quoted": "SELECT DISTINCT \"p_brand\", [p_type] FROM part WHERE p_name LIKE '%RED%'",
    "empty": "SELECT c_name FROM customer WHERE c_acctbal > 1000000",
    "no_table": "SELECT * FROM no_such_table",
    "no_column": "SELECT no_such_column FROM orders",
    "forbidden": "DELETE FROM orders",
}
BATCH_COUNTS = {
    "scan": "FROM orders WHERE o_orderstatus = 'F'|2", "join": "FROM customer JOIN orders ON c_custkey = o_custkey|2",
    "group": "FROM (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)|2",
    "quoted": "FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_name ILIKE '%RED%')|2",
    "empty": "FROM customer WHERE c_acctbal > 1000000|1",
}
BATCH_SQL = "\nUNION ALL ".join(
    [
        f"SELECT '{name}' AS name, true AS success, count(*) AS row_count, {text.split('|')[1]} AS column_count, count(*) = 0 AS is_empty, '' AS diagnosis {text.split('|')[0]}"
        for name, text in BATCH_COUNTS.items()
    ]
    + [
        f"SELECT '{name}', false, -1, -1, false, '{diagnosis}'"
        for name, diagnosis in [("no_table", "table_missing"), ("no_column", "column_missing"), ("forbidden", "unknown_execution_error")]
    ]
)


@query("run_batch", BATCH_SQL)
def run_batch(spark, sf_dir):
    for name, df in tables_of(spark, sf_dir, STAR).items():
        df.createOrReplaceTempView(name)
    asked = spark.createDataFrame(list(BATCH.items()), "name string, sql string")
    done = batch.executed(asked, batch.run_batch(asked))
    return done.select(
        "name", "exec.success", F.coalesce("exec.row_count", F.lit(-1)).alias("row_count"),
        F.coalesce("exec.column_count", F.lit(-1)).alias("column_count"), F.coalesce("exec.is_empty", F.lit(False)).alias("is_empty"),
        F.coalesce(compare.diagnose(F.col("exec.error")), F.lit("")).alias("diagnosis"),
    ).withColumn("diagnosis", F.when(F.col("success"), "").otherwise(F.col("diagnosis")))


DIGESTS = "\nUNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {t})) AS distinct_rows FROM {t}"
    for table in STAR for t, names in [(table, ", ".join(c for c, _ in COLUMNS[table]))]
)


@query("result_digest", f"""{DIGESTS}
UNION ALL SELECT 'order_status', count(*), (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) FROM orders
UNION ALL SELECT 'shipments', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_shipdate FROM lineitem)) FROM lineitem""")
def result_digest(spark, sf_dir):
    t = given(spark, sf_dir)
    parts = [(n, n, [c for c, _ in COLUMNS[n]]) for n in STAR]  # whole rows, and some with repeats
    parts += [("order_status", "orders", ["o_custkey", "o_orderstatus"]), ("shipments", "lineitem", ["l_quantity", "l_discount", "l_shipdate"])]
    found = [result_summary(t[table].select(*names)).select(F.lit(name).alias("name"), "row_count", "distinct_rows") for name, table, names in parts]
    return unite(found)


def _same(a: str, b: str) -> str:
    return f"NOT EXISTS (({a} EXCEPT {b}) UNION ALL ({b} EXCEPT {a}))"


ORDER_COLUMNS = ", ".join(c for c, _ in COLUMNS["orders"])
ORDERS, DEAR = f"SELECT {ORDER_COLUMNS} FROM orders", "o_totalprice > (SELECT avg(o_totalprice) FROM orders)"
TEXTS = ", ".join(f"CAST({c} AS VARCHAR)" for c in ("o_orderkey", "o_custkey", "o_orderstatus"))


@query("results_equal", f"""SELECT 'same_set' AS name, {_same(ORDERS, f"(SELECT DISTINCT {ORDER_COLUMNS} FROM orders ORDER BY o_custkey)")} AS equal
UNION ALL SELECT 'int_and_real', {_same("SELECT CAST(o_orderkey AS DOUBLE), CAST(o_custkey AS DOUBLE) FROM orders", "SELECT o_orderkey, o_custkey FROM orders")}
UNION ALL SELECT 'other_rows', {_same(ORDERS, f"{ORDERS} WHERE {DEAR}")}
UNION ALL SELECT 'customers', {_same("SELECT o_custkey FROM orders", f"SELECT o_custkey FROM orders WHERE {DEAR}")}
UNION ALL SELECT 'repeats', {_same(ORDERS, f"({ORDERS} UNION ALL {ORDERS} WHERE {DEAR})")}
UNION ALL SELECT 'text_typed', NOT EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'text_as_string', {_same(f"SELECT {TEXTS} FROM orders", "SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders")}""")
def results_equal(spark, sf_dir):
    o = given(spark, sf_dir)["orders"].select(*[c for c, _ in COLUMNS["orders"]])
    keys = o.select("o_orderkey", "o_custkey", "o_orderstatus")
    texts = keys.select(*[F.col(c).cast("string").alias(c) for c in keys.columns])
    numbers = o.select("o_orderkey", "o_custkey")
    dear = o.join(o.agg(F.avg("o_totalprice").alias("mean")), F.col("o_totalprice") > F.col("mean")).drop("mean")
    cases = [
        ("same_set", o, o.distinct().orderBy("o_custkey"), "typed"),
        ("int_and_real", numbers.select(*[F.col(c).cast("double") for c in numbers.columns]), numbers, "typed"),
        ("other_rows", o, dear, "typed"),
        ("customers", o.select("o_custkey"), dear.select("o_custkey"), "typed"),
        ("repeats", o, o.unionByName(dear), "typed"),
        ("text_typed", keys, texts, "typed"),
        ("text_as_string", texts, keys, "string"),
    ]
    return unite([compare.results_equal(a, b, mode).select(F.lit(n).alias("name"), "equal") for n, a, b, mode in cases])


PRIORITY = "CASE source WHEN 'metadata_constrained_generator' THEN 5 WHEN 'evidence_focused_generator' THEN 5 WHEN 'reasoning_generator' THEN 4 WHEN 'join_focused_generator' THEN 4 WHEN 'icl_generator' THEN 3 WHEN 'simple_generator' THEN 2 ELSE 0 END"
REPS = f"""cand AS ({CAND}), merits AS (SELECT *, {PRIORITY} - num_repairs AS merit FROM cand),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, result_key ORDER BY merit DESC, pos) AS n,
 count(*) OVER (PARTITION BY question_id, result_key) AS group_size, min(pos) OVER (PARTITION BY question_id, result_key) AS first_pos FROM merits) WHERE n = 1)"""
SCORES = f"""{REPS}, levels AS (SELECT *, CASE WHEN success THEN 10000 ELSE 0 END + CASE WHEN success AND NOT is_empty THEN 1000 ELSE 0 END + merit AS level FROM reps),
pairs AS (SELECT a.question_id, a.candidate_id AS a, b.candidate_id AS b, a.level AS la, b.level AS lb FROM levels a JOIN levels b ON a.question_id = b.question_id AND a.first_pos < b.first_pos),
won AS (SELECT question_id, a AS candidate_id, CASE WHEN la > lb THEN 0.8 WHEN la = lb THEN 0.25 ELSE 0 END AS w FROM pairs
 UNION ALL SELECT question_id, b, CASE WHEN lb > la THEN 0.8 WHEN la = lb THEN 0.25 ELSE 0 END FROM pairs),
scores AS (SELECT l.question_id, l.candidate_id, l.first_pos, l.is_empty, l.success, coalesce(sum(w), 0) AS score FROM levels l LEFT JOIN won w ON w.question_id = l.question_id AND w.candidate_id = l.candidate_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_pos) AS rank FROM scores)"""


@query("exec_grouping", f"WITH {REPS} SELECT question_id, result_key, candidate_id, group_size, first_pos, CAST(pos AS BIGINT) AS pos, CAST(merit AS BIGINT) AS merit FROM reps")
def exec_grouping(spark, sf_dir):
    return selection.execution_groups(candidates(spark, sf_dir)).select(
        "question_id", "result_key", "candidate_id", "group_size", "first_pos", "pos", "merit"
    )


@query("majority_vote", f"""WITH {REPS} SELECT question_id, candidate_id, group_size AS votes FROM (SELECT *, row_number() OVER (PARTITION BY question_id
 ORDER BY group_size DESC, first_pos) AS r FROM reps) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    return selection.majority_vote(selection.execution_groups(candidates(spark, sf_dir)))


@query("rule_select", f"""WITH {REPS} SELECT question_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id
 ORDER BY success DESC, (success AND NOT coalesce(is_empty, false)) DESC, merit DESC, pos) AS r FROM merits) WHERE r = 1""")
def rule_select(spark, sf_dir):
    return selection.rule_select(candidates(spark, sf_dir))


@query("tournament_scores", f"WITH {SCORES} SELECT question_id, candidate_id, CAST(score AS DOUBLE) AS score, rank FROM ranked")
def tournament_scores(spark, sf_dir):
    ranked = selection.level_tournament(stable(selection.execution_groups(candidates(spark, sf_dir))))
    return ranked.select("question_id", "candidate_id", F.col("score").cast("double").alias("score"), "rank")


# A stand-in judge that reads the ids of a pair.
SAID = "substr(md5('judge#' || a_candidate_id || '#' || b_candidate_id), 1, 1)"
JUDGED = f"""{REPS}, lined AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_pos) - 1 AS at, count(*) OVER (PARTITION BY question_id) AS rivals FROM reps),
met AS (SELECT a.question_id, a.candidate_id AS a_candidate_id, b.candidate_id AS b_candidate_id,
 CASE WHEN b.at = b.rivals - 1 AND b.rivals % 2 = 0 THEN 2 * a.at % (b.rivals - 1) ELSE (a.at + b.at) % (b.rivals - 1 + b.rivals % 2) END AS round
 FROM lined a JOIN lined b ON a.question_id = b.question_id AND a.at < b.at),
log AS (SELECT *, CASE WHEN {SAID} < '6' THEN 'A' WHEN {SAID} < 'c' THEN 'B' ELSE 'tie' END AS winner, CASE WHEN {SAID} < 'c' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM met)"""


def _judged_log(spark, sf_dir):
    groups = stable(selection.execution_groups(candidates(spark, sf_dir)))
    said = F.substring(F.md5(F.concat_ws("#", F.lit("judge"), "a_candidate_id", "b_candidate_id")), 1, 1)
    winner = F.when(said < "6", F.lit("A")).when(said < "c", F.lit("B")).otherwise(F.lit("tie"))
    pairs = selection.judge_schedule(groups).withColumn("winner", winner)
    sure = F.when(F.col("winner") == "tie", selection.TIE_CONFIDENCE).otherwise(selection.WIN_CONFIDENCE)
    return groups, selection.comparison_log(pairs.withColumn("confidence", sure))


@query("comparison_log", f"WITH {JUDGED} SELECT question_id, round, a_candidate_id, b_candidate_id, winner, confidence FROM log")
def comparison_log(spark, sf_dir):
    return _judged_log(spark, sf_dir)[1]


@query("judged_ranking", f"""WITH {JUDGED}, won AS (SELECT question_id, a_candidate_id AS candidate_id, CASE winner WHEN 'A' THEN 0.8 WHEN 'B' THEN 0 ELSE 0.25 END AS w FROM log
 UNION ALL SELECT question_id, b_candidate_id, CASE winner WHEN 'B' THEN 0.8 WHEN 'A' THEN 0 ELSE 0.25 END FROM log),
scored AS (SELECT r.question_id, r.candidate_id, r.first_pos, coalesce(sum(w), 0) AS score, count(w) AS comparisons FROM reps r LEFT JOIN won USING (question_id, candidate_id) GROUP BY ALL)
SELECT question_id, candidate_id, CAST(score AS DOUBLE) AS score, comparisons, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_pos) AS rank FROM scored""")
def judged_ranking(spark, sf_dir):
    ranked = selection.judged_tournament(*_judged_log(spark, sf_dir))
    return ranked.select("question_id", "candidate_id", F.col("score").cast("double").alias("score"), "comparisons", "rank")


FINAL = f"""{SCORES}, final AS (SELECT question_id, max(CASE WHEN rank = 1 THEN candidate_id END) AS best_candidate_id, max(CASE WHEN rank = 1 THEN score END) AS best_score,
 max(CASE WHEN rank = 2 THEN score END) AS second_score, bool_and(coalesce(is_empty, false)) FILTER (rank <= 3) AS all_top_empty, count(*) AS num_representatives FROM ranked GROUP BY question_id)"""
SQL_TEXT = "concat('SELECT ', source, ' FROM t WHERE k = ', coalesce(cast(row_count as string), 'NULL'))"


def _final(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("sql", F.expr(SQL_TEXT))
    return selection.select_final(rows)


@query("final_selection", f"""WITH {FINAL}, counts AS (SELECT question_id, count(*) AS num_original_candidates FROM cand GROUP BY question_id)
SELECT question_id, best_candidate_id, final_sql, CAST(best_score AS DOUBLE) AS best_score, num_original_candidates, num_representatives
FROM final JOIN counts USING (question_id) JOIN (SELECT question_id, candidate_id AS best_candidate_id, {SQL_TEXT} AS final_sql FROM cand) USING (question_id, best_candidate_id)""")
def final_selection(spark, sf_dir):
    return _final(spark, sf_dir).select(
        "question_id", "best_candidate_id", "final_sql", F.col("best_score").cast("double").alias("best_score"),
        "num_original_candidates", "num_representatives",
    )


@query("final_ranking", f"WITH {SCORES} SELECT question_id, rank, candidate_id, CAST(score AS DOUBLE) AS score FROM ranked")
def final_ranking(spark, sf_dir):
    _, ranking = selection.select_ranked(candidates(spark, sf_dir).withColumn("sql", F.expr(SQL_TEXT)))
    return ranking.withColumn("score", F.col("score").cast("double"))


@query("hard_cases", f"""WITH {FINAL}, texts AS (SELECT question_id, candidate_id AS best_candidate_id, {SQL_TEXT} AS final_sql FROM cand)
SELECT question_id, coalesce(reason, '') AS reason, reason IS NOT NULL AS hard_case FROM (SELECT question_id, CASE WHEN num_representatives < 2 THEN NULL WHEN best_score - second_score < 0.5 THEN 'low_margin'
 WHEN all_top_empty THEN 'all_empty' WHEN NOT contains(final_sql, CAST(question_id % 4 AS VARCHAR)) THEN 'constraint_not_covered' END AS reason FROM final JOIN texts USING (question_id, best_candidate_id))""")
def hard_case_reasons(spark, sf_dir):
    final = _final(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    constraints = final.select(
        "question_id",
        F.array(
            F.struct(F.lit("t.K").alias("column"), (F.col("question_id") % 4).cast("string").alias("value"), F.lit(False).alias("parse_error")),
            F.struct(nothing.alias("column"), nothing.alias("value"), F.lit(None).cast("boolean").alias("parse_error")),
        ).alias("constraints"),
    )
    found = hard_cases.hard_cases(final, constraints)
    return found.select("question_id", F.coalesce("reason", F.lit("")).alias("reason"), "hard_case")


@query("candidate_errors", f"""SELECT question_id, pos, source, coalesce(error, '') AS error, CASE WHEN success THEN 'empty_result' ELSE '' END AS issue, substr({SQL_TEXT}, 1, 200) AS sql
FROM ({CAND}) WHERE NOT success OR is_empty""")
def candidate_errors(spark, sf_dir):
    found = hard_cases.candidate_errors(candidates(spark, sf_dir).withColumn("sql", F.expr(SQL_TEXT)))
    return found.withColumns({"error": F.coalesce("error", F.lit("")), "issue": F.coalesce("issue", F.lit(""))})


@query("reselect_merge", f"""WITH {FINAL} SELECT question_id, CASE WHEN hard AND question_id % 2 = 0 THEN -best_candidate_id ELSE best_candidate_id END AS best_candidate_id, hard AND question_id % 2 = 0 AS refined
FROM (SELECT *, num_representatives > 1 AND (best_score - second_score < 0.5 OR all_top_empty) AS hard FROM final)""")
def reselect_merge(spark, sf_dir):
    first = hard_cases.hard_cases(_final(spark, sf_dir)).select("question_id", "best_candidate_id", "hard_case")
    second = first.filter("hard_case AND question_id % 2 = 0").select("question_id", (-F.col("best_candidate_id")).alias("best_candidate_id"))
    return hard_cases.reselected(first, second).select("question_id", "best_candidate_id", "refined")
