"""Query logs: features, joins, mutations, cleaning, validation; prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesage.functions.text import clean_json, clean_sql, token_estimate
from tablesage.operators import compare, mutations, prompts, query_logs
from tablesage.plans.inputs import CAND, QLOG, QST, candidates, given, query_log, query_log_by_row, select
from tablesage.plans.registry import query


def _joined(*columns):
    return {c: F.array_join(c, ";") for c in columns}


TABLES_SQL = r"list_sort(list_distinct(regexp_extract_all(sql, '(?:FROM|JOIN) (\w+)', 1)))"
REFS_SQL = r"list_sort(list_distinct(regexp_extract_all(sql, '\b[a-z]\.[a-z]_\w+')))"
ONS_SQL = r"regexp_extract_all(sql, '\w\.\w+ = \w\.\w+_\w*key\b')"


@query("qlog_features", f"""SELECT question_id, array_to_string({TABLES_SQL}, ';') AS tables, array_to_string({REFS_SQL}, ';') AS columns,
 array_to_string(regexp_extract_all(sql, 'ON (\\w\\.\\w+ = \\w\\.\\w+)', 1), ';') AS joins,
 regexp_extract(sql, '(WHERE .+?)(?: ORDER BY| GROUP BY|$)', 1) AS "where",
 regexp_extract(sql, '(GROUP BY .+?)(?: ORDER BY|$)', 1) AS group_by, false AS parse_error FROM ({QLOG})""".replace("\\\\", "\\"))
def qlog_features(spark, sf_dir):
    shown = _joined("tables", "columns", "joins") | {c: F.coalesce(c, F.lit("")) for c in ("where", "group_by")}
    return query_logs.log_features(query_log_by_row(spark, sf_dir)).withColumns(shown).drop("sql")


@query("qlog_join_edges", f"""WITH e AS (SELECT unnest(regexp_extract_all(sql, '(\\w\\.\\w+ = \\w\\.\\w+)')) AS e FROM ({QLOG}) WHERE contains(sql, ' JOIN ')),
named AS (SELECT CASE substr(a, 1, 1) WHEN 'c' THEN 'customer' WHEN 'o' THEN 'orders' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' WHEN 'r' THEN 'region' END || substr(a, 2) AS a,
 CASE substr(b, 1, 1) WHEN 'c' THEN 'customer' WHEN 'o' THEN 'orders' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' WHEN 'r' THEN 'region' END || substr(b, 2) AS b
 FROM (SELECT split_part(e, ' = ', 1) AS a, split_part(e, ' = ', 2) AS b FROM e))
SELECT least(a, b) AS left_column, greatest(a, b) AS right_column, count(*) AS uses FROM named GROUP BY ALL""".replace("\\\\", "\\"))
def qlog_join_edges(spark, sf_dir):
    return query_logs.join_edges(query_log(spark, sf_dir))


@query("qlog_item_counts", f"""SELECT kind, name, count(*) AS uses FROM (SELECT 'table' AS kind, unnest({TABLES_SQL}) AS name FROM ({QLOG})
 UNION ALL SELECT 'column', unnest({REFS_SQL}) FROM ({QLOG})) GROUP BY ALL""")
def qlog_item_counts(spark, sf_dir):
    return query_logs.item_frequencies(query_log(spark, sf_dir))


def _named(list_sql: str) -> str:
    """Qualified names of a list of alias.column references, sorted and distinct, as one text."""
    table = "CASE substr(c, 1, 1) WHEN 'c' THEN 'customer' WHEN 'o' THEN 'orders' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' WHEN 'r' THEN 'region' WHEN 'p' THEN 'part' ELSE 'lineitem' END"
    return f"array_to_string(list_sort(list_distinct(list_transform({list_sql}, lambda c: {table} || substr(c, 2)))), ';')"


REF = r"\b[a-z]\.[a-z]_\w+"


@query("qlog_clause_roles", f"""SELECT question_id, array_to_string({TABLES_SQL}, ';') AS tables_used,
 {_named(f"regexp_extract_all(sql, '{REF}')")} AS columns_used,
 {_named(f"regexp_extract_all(regexp_extract(sql, 'SELECT (.+?) FROM', 1), '{REF}')")} AS selected_columns,
 {_named(f"regexp_extract_all(regexp_extract(sql, 'WHERE (.+?)( ORDER BY| GROUP BY|$)', 1), '{REF}')")} AS where_columns,
 {_named(f"regexp_extract_all(regexp_extract(sql, 'GROUP BY (.+?)( ORDER BY|$)', 1), '{REF}')")} AS group_by_columns,
 {_named(f"regexp_extract_all(regexp_extract(sql, 'ORDER BY (.+?)( LIMIT|$)', 1), '{REF}')")} AS order_by_columns,
 array_to_string(regexp_extract_all(sql, '(SUM|COUNT|AVG|MIN|MAX)\\(', 1), ';') AS aggregation_functions,
 array_to_string(list_transform(regexp_extract_all(sql, '''[A-Z]''|[ ]\\d+'), lambda v: trim(v, ' ''')), ';') AS literals_used
FROM ({QLOG})""".replace("\\\\", "\\"))
def qlog_clause_roles(spark, sf_dir):
    names = ["tables_used", "columns_used", "selected_columns", "where_columns", "group_by_columns", "order_by_columns", "aggregation_functions", "literals_used"]
    return query_logs.clause_roles(query_log_by_row(spark, sf_dir)).withColumns(_joined(*names)).select("question_id", *names)


def _pick_sql(options: str, seed: int) -> str:
    place = f"CAST('0x' || substr(md5(concat(sql, '#{seed}')), 1, 8) AS BIGINT) % len({options})"
    return f"CASE WHEN len({options}) > 0 THEN {options}[CAST({place} + 1 AS INT)] END"


LITERALS = r"regexp_extract_all(sql, '''\w+''|\b\d+\b')"
NAMES = r"regexp_extract_all(sql, '\b\w+\.\w+\b')"
WORDS = r"regexp_extract_all(string_split(lower(sql), 'where')[2], '\b\w+\b')"
MUTATED = f"""picked AS (SELECT *, {_pick_sql(LITERALS, 0)} AS lit, {_pick_sql(NAMES, 1)} AS col,
 CASE WHEN contains(lower(sql), 'where') THEN {_pick_sql(WORDS, 2)} END AS word FROM base),
made AS (SELECT *, [
 CASE WHEN contains(lower(sql), 'distinct') THEN regexp_replace(sql, '\\bdistinct\\b', '', 'gi') END,
 CASE WHEN contains(replace(lower(sql), ' ', ''), 'count(distinct') THEN regexp_replace(sql, 'count\\s*\\(\\s*distinct[^)]+\\)', 'COUNT(*)', 'gi') END,
 CASE WHEN contains(lower(sql), 'desc') THEN regexp_replace(sql, '\\bdesc\\b', 'ASC', 'gi') WHEN contains(lower(sql), 'asc') THEN regexp_replace(sql, '\\basc\\b', 'DESC', 'gi') END,
 CASE WHEN contains(lower(sql), 'group by') THEN regexp_replace(sql, '\\bgroup\\s+by\\s+.*?(order\\s+by\\b|limit\\b|$)', '\\1', 'gi') END,
 CASE WHEN contains(lower(sql), 'where') THEN regexp_replace(sql, '\\bwhere\\s+.*?(group\\s+by\\b|order\\s+by\\b|limit\\b|$)', '\\1', 'gi') END,
 replace(replace(replace(replace(sql, 'SUM(', 'AVG~('), 'MAX(', 'MIN~('), 'AVG~(', 'AVG('), 'MIN~(', 'MIN('),
 replace(sql, lit, CASE WHEN regexp_full_match(lit, '\\d+') THEN CAST(CAST(lit AS BIGINT) + 1 AS VARCHAR) ELSE '''' || trim(lit, '''') || '__mutated''' END),
 CASE WHEN contains(lower(sql), ' join ') AND contains(lower(sql), ' on ') THEN regexp_replace(sql, '(\\bON\\b\\s+\\w+\\.)(\\w+)(\\s*=\\s*\\w+\\.)(\\w+)', '\\1\\2_id\\3\\4', 'gi') END,
 CASE WHEN contains(lower(sql), 'cast(') THEN regexp_replace(sql, 'cast\\s*\\((.*?)\\s+as\\s+\\w+\\)', '\\1', 'gi') ELSE replace(sql, col, 'CAST(' || col || ' AS TEXT)') END,
 replace(sql, word, word || '_mut')] AS texts FROM picked),
long AS (SELECT question_id, sql, unnest(['remove_distinct', 'count_star_vs_count_distinct', 'wrong_order_direction', 'remove_group_by', 'remove_where_condition',
 'replace_aggregation', 'replace_literal', 'wrong_join_column', 'remove_cast_or_add_wrong_cast', 'replace_filter_column']) AS kind,
 unnest(texts) AS text FROM made),
mutated AS (SELECT question_id, sql, kind, replace(trim(text), '  ', ' ') AS mutated_sql FROM long
 WHERE text IS NOT NULL AND replace(trim(text), '  ', ' ') <> replace(trim(sql), '  ', ' '))""".replace("\\\\", "\\")


@query("mutate_queries", f"WITH base AS ({QLOG}), {MUTATED} SELECT question_id, kind, mutated_sql FROM mutated")
def mutate_queries(spark, sf_dir):
    return mutations.mutate_queries(query_log(spark, sf_dir)).select("question_id", "kind", "mutated_sql")


@query("candidate_pool", f"""WITH base AS ({QLOG}), {MUTATED}
SELECT question_id, question_id || '_gold' AS candidate_id, 'gold' AS source, sql FROM base
UNION ALL SELECT question_id, question_id || '_mut_' || kind, 'mutation_' || kind, mutated_sql FROM mutated
UNION ALL SELECT question_id, question_id || '_gen_reasoning_0', 'reasoning_generator', replace(sql, 'SELECT', 'select') FROM base
UNION ALL SELECT question_id, question_id || '_gen_join_0', 'join_focused_generator', string_split(sql, 'JOIN')[1] FROM base WHERE contains(lower(sql), 'join')""")
def candidate_pool(spark, sf_dir):
    samples = query_log(spark, sf_dir).select("question_id", F.lit("tpch").alias("db_id"), F.col("sql").alias("SQL"))
    return mutations.candidate_pool(samples).select("question_id", "candidate_id", "source", "sql")


FENCED = f"""SELECT question_id, CASE CAST(question_id AS BIGINT) % 4 WHEN 0 THEN concat('```sql\\n', sql, '\\n```') WHEN 1 THEN concat('```SQL ', sql, ' ```  ')
 WHEN 2 THEN concat('  ', sql, ' ') ELSE sql END AS answer FROM ({QLOG})"""


@query("clean_sql", f"SELECT question_id, sql FROM ({QLOG})")
def clean_sql_answers(spark, sf_dir):
    return select(spark, sf_dir, FENCED, ["orders"]).select("question_id", clean_sql(F.col("answer")).alias("sql"))


JSON_ANSWERS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json ', props, ' ```') WHEN 2 THEN concat('Here it is: ', props, ' as asked')
 ELSE concat('no json ', event_type) END AS answer FROM events"""


@query("clean_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k, event_id % 4 = 3 AS parse_error FROM events")
def clean_json_answers(spark, sf_dir):
    body = clean_json(F.col("answer"))
    return select(spark, sf_dir, JSON_ANSWERS, ["events"]).select(
        "event_id", F.coalesce(F.get_json_object(body, "$.k").cast("bigint"), F.lit(-1)).alias("k"), body.isNull().alias("parse_error")
    )


@query("token_estimate", """SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INT) AS tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return given(spark, sf_dir)["documents"].select("doc_id", token_estimate(F.col("text")).alias("tokens"))


JUDGE_ANSWERS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'A' WHEN 1 THEN ' b ' WHEN 2 THEN 'TIE' WHEN 3 THEN 'SQL B' WHEN 4 THEN 'Because of it' WHEN 5 THEN ''
 WHEN 6 THEN concat('the ', event_type) ELSE event_type END AS answer FROM events"""


@query("judge_parse", f"""SELECT event_id, winner, CASE WHEN winner = 'tie' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM (SELECT event_id,
 CASE WHEN u IN ('A', 'B') THEN u WHEN u = 'TIE' THEN 'tie' WHEN contains(substr(u, 1, 5), 'A') THEN 'A' WHEN contains(substr(u, 1, 5), 'B') THEN 'B' ELSE 'tie' END AS winner
 FROM (SELECT event_id, upper(trim(answer)) AS u FROM ({JUDGE_ANSWERS})))""")
def judge_parse(spark, sf_dir):
    winner = prompts.judge_winner(F.col("answer"))
    rows = select(spark, sf_dir, JUDGE_ANSWERS, ["events"]).select("event_id", winner.alias("winner"))
    return rows.withColumn("confidence", prompts.judge_confidence(F.col("winner")))


SAMPLES = f"""SELECT CAST(o_orderkey AS BIGINT) AS row, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS question_id,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nowhere' ELSE 'tpch' END AS db_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS question,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'SELECT (1 FROM t' WHEN o_orderkey % 19 = 0 THEN 'DROP TABLE t' ELSE 'SELECT 1' END AS SQL FROM orders"""


@query("validate_rows", f"""SELECT row, coalesce(question_id, 'train_' || CAST(row AS VARCHAR)) AS question_id, array_to_string(list_filter([
 CASE WHEN db_id IS NULL THEN 'missing db_id' END, CASE WHEN question = '' THEN 'missing question' END, CASE WHEN SQL IS NULL THEN 'missing SQL' END,
 CASE WHEN db_id = 'nowhere' THEN 'unknown database' END, CASE WHEN SQL IN ('SELECT (1 FROM t', 'DROP TABLE t') THEN 'SQL parsing failed' END], lambda e: e IS NOT NULL), ';') AS errors
FROM ({SAMPLES})""")
def validate_rows(spark, sf_dir):
    samples = select(spark, sf_dir, SAMPLES, ["orders"])
    known = spark.createDataFrame([("tpch",)], "db_id string")
    return query_logs.validate_samples(samples, known).select("row", "question_id", F.array_join("errors", ";").alias("errors"))


CONTEXTS = f"""SELECT question_id, db_id, question, evidence, p_name, p_brand FROM ({QST}) q JOIN part ON CAST(p_partkey AS STRING) = question_id"""
PLAN_COLUMNS = ["part.p_name", "part.p_brand", "customer.c_mktsegment"]


def _plan_sql() -> str:
    parts = []
    pos = 0
    columns, schema = "\n".join(PLAN_COLUMNS), "CREATE TABLE part (p_name TEXT);"
    body = {
        "question": "question", "evidence": "evidence", "columns": f"'{columns}'", "matched": "p_name || chr(10) || p_brand", "schema": f"'{schema}'",
        "examples": "''", "joins": "'part.p_partkey = lineitem.l_partkey'", "rules": "''", "constraints": "evidence",
    }
    for family in prompts.FAMILIES:
        quoted = family.rules.replace("'", "''")
        sections = " || chr(10) || chr(10) || ".join(f"'{prompts.HEADINGS[s]}' || chr(10) || {body[s]}" for s in family.sections)
        text = f"'{family.task}' || chr(10) || chr(10) || {sections} || chr(10) || chr(10) || '{quoted}'"
        for i in range(family.count):
            temperature = round(family.first_temperature + i * family.temperature_step, 10)
            parts.append(
                f"SELECT question_id, {pos} AS pos, '{family.source}' AS source, '{family.prompt_id.format(i=i)}' AS prompt_id, {temperature}::DOUBLE AS temperature, {text} AS prompt FROM c"
            )
            pos += 1
    return f"WITH c AS ({CONTEXTS}) " + "\nUNION ALL ".join(parts)


@query("prompt_plan", _plan_sql())
def prompt_plan(spark, sf_dir):
    rows = select(spark, sf_dir, CONTEXTS, ["part", "customer"])
    contexts = rows.select(
        "question_id", "db_id", "question", "evidence", F.array(*[F.lit(c) for c in PLAN_COLUMNS]).alias("columns"),
        F.array("p_name", "p_brand").alias("matched"), F.array("evidence").alias("constraints"),
        F.array(F.lit("part.p_partkey = lineitem.l_partkey")).alias("joins"), F.array().cast("array<string>").alias("rules"),
        F.array().cast("array<string>").alias("examples"), F.lit("CREATE TABLE part (p_name TEXT);").alias("schema"),
    )
    return prompts.prompt_plan(contexts).drop("db_id")


@query("candidate_ids", f"""SELECT question_id, question_id || '_cand_' || CAST(row_number() OVER (PARTITION BY question_id ORDER BY family, repetition) - 1 AS VARCHAR) AS candidate_id, source
FROM (SELECT CAST(question_id AS VARCHAR) AS question_id, source, list_position(['reasoning_generator', 'icl_generator', 'metadata_constrained_generator', 'evidence_focused_generator', 'join_focused_generator', 'simple_generator'], source) AS family,
 candidate_id AS repetition FROM ({CAND}))""")
def candidate_ids(spark, sf_dir):
    order = [f.source for f in prompts.FAMILIES]
    rows = candidates(spark, sf_dir).select(
        F.col("question_id").cast("string").alias("question_id"), "source", F.col("candidate_id").alias("repetition")
    )
    family = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    return prompts.numbered_candidates(rows, family).select("question_id", "candidate_id", "source")


@query("diagnose_errors", f"""SELECT diagnosis, count(*) AS n FROM (SELECT CASE WHEN contains(lower(error), 'no such column') THEN 'column_missing'
 WHEN contains(lower(error), 'no such table') THEN 'table_missing' WHEN contains(lower(error), 'syntax error') THEN 'syntax_error' ELSE 'unknown_execution_error' END AS diagnosis
 FROM ({CAND}) WHERE NOT success) GROUP BY diagnosis""")
def diagnose_errors(spark, sf_dir):
    failed = candidates(spark, sf_dir).filter(~F.col("success"))
    return failed.groupBy(compare.diagnose(F.col("error")).alias("diagnosis")).agg(F.count(F.lit(1)).alias("n"))
