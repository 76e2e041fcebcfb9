import json

import pytest
from pyspark.sql import functions as F

from tablesage.functions.compat import int_div, loose_real, ratio
from tablesage.operators import batch, compare, mutations, prompts, query_logs, training_sets
from tablesage.operators.inference import RecordedModel, answer_prompts, constant_model
from tablesage.operators.rounds import repair
from tablesage.plans import inputs
from tablesage.plans.registered import QUERIES
from tablesage.sources import jsonio


def mutated(spark, sql):
    df = spark.createDataFrame([(sql,)], "sql string")
    return {r.kind: r.mutated_sql for r in mutations.mutate_queries(df).collect()}


def test_mutations(spark):
    sql = "SELECT COUNT(DISTINCT a.x), SUM(a.y), AVG(a.z) FROM a JOIN b ON a.k = b.k WHERE a.v = 'w' GROUP BY a.g ORDER BY a.g DESC LIMIT 5"
    m = mutated(spark, sql)
    assert m["remove_distinct"].startswith("SELECT COUNT( a.x)")
    assert m["count_star_vs_count_distinct"].startswith("SELECT COUNT(*), SUM")
    assert m["wrong_order_direction"].endswith("ORDER BY a.g ASC LIMIT 5")
    assert m["remove_group_by"].endswith("'w' ORDER BY a.g DESC LIMIT 5")
    assert m["remove_where_condition"].endswith("b.k GROUP BY a.g ORDER BY a.g DESC LIMIT 5")
    assert "AVG(a.y), SUM(a.z)" in m["replace_aggregation"]
    assert "ON a.k_id = b.k" in m["wrong_join_column"]
    assert m["replace_literal"] != sql
    assert "_mut" in mutated(spark, "select x from t where a = 1")["replace_filter_column"]
    assert mutated(spark, "SELECT CAST(x AS REAL) FROM t")["remove_cast_or_add_wrong_cast"] == "SELECT x FROM t"
    assert "replace_aggregation" not in mutated(spark, "SELECT x FROM t")  # no change, dropped


def test_mutation_patterns_stop_at_line_ends(spark):
    m = mutated(spark, "SELECT x FROM t WHERE a = 1\nAND b = 2")
    assert "remove_where_condition" not in m  # the condition runs over two lines and is left alone
    assert mutated(spark, "SELECT x\nFROM t WHERE a = 1")["remove_where_condition"] == "SELECT x\nFROM t"
    nested = mutated(spark, "SELECT x FROM (SELECT y FROM t WHERE a = 1) LIMIT 2")
    assert nested["remove_where_condition"] == "SELECT x FROM (SELECT y FROM t LIMIT 2"


def test_log_features_and_roles(spark):
    sql = "SELECT T1.`Zip`, count FROM schools AS T1 INNER JOIN frpm T2 ON T1.[CDS] = T2.CDS WHERE T2.name = 'from x' AND T2.n > 3.5 GROUP BY T1.Zip"
    log = spark.createDataFrame([("a", sql), ("b", "SELECT (1 FROM"), ("c", "DROP TABLE x")], "question_id string, sql string")
    rows = {r.question_id: r for r in query_logs.log_features(log).collect()}
    a = rows["a"]
    assert a.tables == ["frpm", "schools"] and a.joins == ["T1.CDS = T2.CDS"] and not a.parse_error
    assert a.columns == ["T1.CDS", "T1.Zip", "T2.CDS", "T2.n", "T2.name", "count"]
    assert a["where"] == "WHERE T2.name = 'from x' AND T2.n > 3.5" and a.group_by == "GROUP BY T1.Zip"
    assert rows["b"].parse_error and rows["c"].parse_error and rows["b"].tables is None
    roles = {r.question_id: r for r in query_logs.clause_roles(log).collect()}["a"]
    assert roles.columns_used == ["count", "frpm.CDS", "frpm.n", "frpm.name", "schools.CDS", "schools.Zip"]
    assert roles.where_columns == ["frpm.n", "frpm.name"] and roles.group_by_columns == ["schools.Zip"]
    assert roles.literals_used == ["from x", "3.5"]
    edges = query_logs.join_edges(log).collect()
    assert [(e.left_column, e.right_column, e.uses) for e in edges] == [("frpm.CDS", "schools.CDS", 1)]
    columns = spark.createDataFrame([("schools", "Zip"), ("frpm", "n"), ("frpm", "nowhere")], "table_name string, column_name string")
    support = {r.column_name: r.query_log_support for r in query_logs.column_log_support(columns, log).collect()}
    assert support == {"Zip": 1 / 3, "n": 1 / 3, "nowhere": 0.0}


QUOTED = [
    ("SELECT `Free Meal Count (K-12)` / `Enrollment` FROM frpm ORDER BY `Free Meal Count (K-12)` DESC LIMIT 1", ["frpm"], ["Enrollment", "Free Meal Count (K-12)"], None, None),
    ("SELECT T2.Zip FROM frpm AS T1 INNER JOIN schools AS T2 ON T1.`CDS Code` = T2.`CDS Code` WHERE T1.`Charter School (Y/N)` = 1",
     ["frpm", "schools"], ["T1.CDS Code", "T1.Charter School (Y/N)", "T2.CDS Code", "T2.Zip"], "WHERE T1.`Charter School (Y/N)` = 1", None),
    ("SELECT a.x FROM t1 a, t2 b, t3 WHERE a.id = b.id", ["t1", "t2", "t3"], ["a.id", "a.x", "b.id"], "WHERE a.id = b.id", None),
    ("SELECT x FROM `my table` WHERE b IN (SELECT c FROM u WHERE d = 1 GROUP BY c) AND f > 2",
     ["my table", "u"], ["b", "c", "d", "f", "x"], "WHERE b IN (SELECT c FROM u WHERE d = 1 GROUP BY c) AND f > 2", None),
    ("SELECT y, MAX(z) FROM [a b] GROUP BY y HAVING COUNT(*) > (SELECT 1) ORDER BY y", ["a b"], ["y", "z"], None, "GROUP BY y"),
    ("(SELECT p FROM q WHERE r = 'FROM a, b')", ["q"], ["p", "r"], "WHERE r = 'FROM a, b'", None),
]


def test_quoted_names_lists_and_nested_clauses(spark):
    from tablesage.operators.query_logs import join_edges, log_features

    log = spark.createDataFrame([(q,) for q, *_ in QUOTED], "sql string")
    got = {r.sql: (r.tables, r.columns, r.where, r.group_by) for r in log_features(log).collect()}
    for text, *expected in QUOTED:
        assert got[text] == tuple(expected), text
    edges = [(r.left_column, r.right_column, r.uses) for r in join_edges(log).collect()]
    assert edges == [("frpm.CDS Code", "schools.CDS Code", 1)]


def equal(a, b, mode="typed"):
    found = compare.results_equal(a, b, mode)
    return found if isinstance(found, bool) else found.first()[0]


def test_logs_read_by_row_come_in_bounded_parts(spark, tmp_path, monkeypatch):
    rows = spark.range(900).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(inputs, "LOG_ROWS", 100)
    roles = QUERIES["qlog_clause_roles"](spark, str(tmp_path))
    assert roles.rdd.getNumPartitions() == 9 and roles.count() == 900
    spark.catalog.dropTempView("orders")


def test_columns_of_ranker_rows_are_read_once(spark):
    """What a column says by itself is not made again for every query it meets, and a small catalog is not dealt."""
    log = spark.createDataFrame([("q1", "d", "SELECT t.a_size FROM t WHERE t.a_size = 'X'"), ("q2", "d", "SELECT (1 FROM t")], "question_id string, db_id string, question string")
    entry = "db_id string, table_name string, column_name string, data_type string, top_values array<struct<value:string,count:long>>"
    profiles = spark.createDataFrame([("d", "t", "a_size", "string", [("x", 2)]), ("d", "t", "b", "int", [("1", 1)]), ("d", "u", "c", "int", []), ("e", "t", "b", "int", [])], entry)
    rows = training_sets.ranker_rows(query_logs.clause_roles(log.withColumnRenamed("question", "sql")), log, profiles)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "split(lower(column_name" not in plan
    found = {r.candidate: (r.name_overlap, r.literal_exact_match, r.profile_type_match, r.label, r.semantic_sim_question_column, r.literal_fuzzy_match) for r in rows.collect()}
    assert found == {"t.a_size": (0.0, 1, 1, 2, 0.8571, 1.0), "t.b": (0.0, 0, 0, 1, 0.0, 0.0), "u.c": (0.0, 0, 0, 0, 0.2857, 0.0)}


def test_roles_that_nobody_reads_are_not_made(spark):
    log = spark.createDataFrame([("a", "SELECT t.x FROM t AS u WHERE u.y = 'z'"), ("b", "SELECT (1")], "question_id string, sql string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    clauses = r"group\s+by\s+(.+?)"
    roles = query_logs.clause_roles(log)
    assert clauses in plan(roles)
    few = plan(roles.filter(~F.col("parse_error")).select("question_id", "tables_used", "columns_used", "literals_used"))
    assert clauses not in few and few.count("regexp_extract_all(_bare") == 3 and few.count("regexp_extract_all(coalesce(_bare") == 1  # tables, aliases, given names, columns
    assert roles.columns == ["question_id", "sql", "tables_used", "join_predicates", "aggregation_functions", "literals_used", "parse_error",
                             "columns_used", "selected_columns", "where_columns", "group_by_columns", "order_by_columns"]


def test_ranker_rows_are_told_by_question(spark, monkeypatch):
    """Words and values are compared per question; pairs only pick, with the rows that comparing each pair gives."""
    texts = ["SELECT t.a_size FROM t WHERE t.a_size = 'Xé'", "SELECT count(*) FROM u JOIN t AS w ON w.b = u.c WHERE w.b > 12 AND u.c = 'x1'", "SELECT a size FROM t", "SELECT (1 FROM t", None, "SELECT 'B'"]
    log = spark.createDataFrame([(f"q{i % 5}", "dezd"[i % 4] if i != 5 else None, q) for i, q in enumerate([*texts, *texts[:3]])], "question_id string, db_id string, question string")
    entry = "db_id string, table_name string, column_name string, data_type string, top_values array<struct<value:string,count:long>>"
    profiles = spark.createDataFrame([
        ("d", "t", "A_size", "string", [("xÉ", 2), ("y", 1), ("", 1)]), ("d", "t", "b", "int", [("12", 1), ("1", 1)]), ("d", "u", "c", "int", []), ("d", "u", "", None, [("x1", 1)]),
        ("e", "t", "b_size_b", "int", [("2", 1)]), ("f", "t", "b", "int", []),
    ], entry)
    ranked = lambda fuzzy: training_sets.ranker_rows(query_logs.clause_roles(log.withColumnRenamed("question", "sql")), log, profiles, fuzzy)
    plan = ranked(False)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "arrays_overlap" not in plan
    found = {fuzzy: (ranked(fuzzy).columns, sorted(map(str, ranked(fuzzy).collect()))) for fuzzy in (False, True)}
    monkeypatch.setattr(training_sets, "COLUMNS_AT_ONCE", 0)
    assert found == {fuzzy: (ranked(fuzzy).columns, sorted(map(str, ranked(fuzzy).collect()))) for fuzzy in (False, True)}
    assert len(found[True][1]) > 10


def test_prompts_are_made_where_they_are_asked(spark, tmp_path):
    """What prompts are made of travels, once a question; the prompts, one for each call, do not."""
    contexts = spark.createDataFrame([(f"q{i}", "d", "t" * i) for i in range(9)], "question_id string, db_id string, text string")
    calls = F.array(*[F.struct(F.lit(n).alias("pos"), F.concat(F.lit(f"{n}: "), "text").alias("prompt"), F.lit(0.1).alias("temperature")) for n in range(3)])
    make = lambda rows: rows.select("question_id", F.inline(calls))
    told = lambda texts, temperatures: [f"<{t}>" for t in texts]
    ask = lambda model: answer_prompts(contexts, model, ["question_id", "pos"], keep=False, make=make, spread=["question_id"])
    plan = ask(told)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression")
    wanted = {(f"q{i}", n): f"<{n}: {'t' * i}>" for i in range(9) for n in range(3)}
    for model in (told, RecordedModel(told, str(tmp_path / "a")), RecordedModel(told, str(tmp_path / "a"))):
        assert {(r.question_id, r.pos): r.answer for r in ask(model).collect()} == wanted


def test_results_equal(spark):
    def df(values, kind):
        return spark.createDataFrame([(v,) for v in values], f"x {kind}")

    ints, reals, texts = df([1, 2, 2], "int"), df([2.0, 1.0], "double"), df(["1", "2"], "string")
    assert equal(ints, reals) and not equal(ints, texts) and equal(ints, texts, "string") and not equal(ints, reals, "string")
    assert equal(df([None], "int"), df([None], "string")) and equal(df([None], "int"), df(["None"], "string"), "string")
    assert not equal(df([None], "int"), df(["None"], "string"))
    two = spark.createDataFrame([], "a int, b int")
    assert equal(df([], "int"), two) and not equal(ints, ints.select("x", F.col("x").alias("x")))
    assert equal(None, ints) is False and not equal(df([1], "int"), df([1, 2], "int"))
    big = df([2**53, 2**53 + 1], "bigint")
    assert not equal(big, big.limit(1))


def test_run_batch(spark, tmp_path):
    spark.createDataFrame([(1, "Ab"), (2, "ab"), (2, "ab")], "k int, v string").createOrReplaceTempView("batch_t")
    texts = [
        "SELECT k FROM batch_t", "SELECT k * 1.0E0 AS r FROM batch_t ORDER BY 1 DESC", "SELECT v FROM batch_t WHERE v LIKE 'A%'",
        "SELECT [k], \"v\" FROM batch_t", "SELECT no FROM batch_t", "SELECT 1 FROM nowhere", "SELEC 1", "INSERT INTO batch_t VALUES (1, 'x')",
        "SELECT k FROM batch_t WHERE k > 5",
    ]
    q = spark.createDataFrame([(t,) for t in texts], "sql string")
    path = str(tmp_path / "runs")
    found = {r.sql: r.exec for r in batch.run_batch(q, path).collect()}
    assert found[texts[0]].digest == found[texts[1]].digest and found[texts[0]].row_count == 3
    assert found[texts[2]].row_count == 3 and found[texts[3]].columns == ["k", "v"]
    assert json.loads(found[texts[3]].sample_rows[0]) == ["1", "Ab"]
    assert found[texts[8]].is_empty and not found[texts[7]].success and found[texts[4]].is_empty is None
    diagnosed = spark.createDataFrame([(t, found[t].error) for t in texts[4:7]], "t string, e string")
    assert {r.t: r.d for r in diagnosed.select("t", compare.diagnose(F.col("e")).alias("d")).collect()} == {
        texts[4]: "column_missing", texts[5]: "table_missing", texts[6]: "unknown_execution_error",
    }
    assert batch.run_batch(q, path).count() == len(texts)  # nothing is run or recorded twice


DIALECT = [
    ("SELECT CAST(k AS TEXT) AS x FROM dialect_t WHERE k = 7", ["7"]),
    ("SELECT CAST(16777217 AS REAL) AS x", ["1.6777217E7"]),
    ("SELECT strftime('%Y-%m', d) AS x FROM dialect_t WHERE k = 7", ["2024-03"]),
    ("SELECT IIF(k > 1, 'a, (b', 'LIKE') AS x FROM dialect_t WHERE k = 7", ["a, (b"]),
    ("SELECT group_concat(v) AS x FROM dialect_t WHERE k = 7", ["x1"]),
    ("SELECT group_concat(v, '; ') AS x FROM dialect_t WHERE k = 7", ["x1"]),
    ("SELECT total(k) AS x FROM dialect_t WHERE k > 100", ["0.0"]),
    ("SELECT k / 0 AS x FROM dialect_t WHERE k = 7", [None]),
    ("SELECT CAST(v AS INTEGER) AS x FROM dialect_t WHERE k = 7", [None]),
    ("SELECT k AS x FROM dialect_t WHERE n = 5", ["7"]),
    ("SELECT `k` AS x FROM dialect_t WHERE v = 'as text) [v] \"v\"' OR k = 7", ["7"]),
]


def test_candidates_dialect_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(batch, "CHUNK", 4)  # more texts than a chunk holds, and no path
    spark.sql("SELECT 7 AS k, 'x1' AS v, '5' AS n, DATE'2024-03-02' AS d").createOrReplaceTempView("dialect_t")
    found = {r.sql: r.exec for r in batch.run_batch(spark.createDataFrame([(t,) for t, _ in DIALECT], "sql string")).collect()}
    assert len(found) == len(DIALECT)
    for text, row in DIALECT:
        assert found[text].error is None and json.loads(found[text].sample_rows[0]) == row, (text, found[text])


def test_own_errors_have_classes(spark):
    from tablesage.operators.metrics import error_class

    texts = [("SELECT no FROM range(1)", "wrong_column"), ("SELECT 1 FROM nowhere", "wrong_table"), ("SELECT ((1 FROM range(1)", "syntax_error"), ("DROP TABLE x", "execution_error")]
    found = batch.run_batch(spark.createDataFrame([(t,) for t, _ in texts], "sql string")).select("sql", "exec.*")
    got = found.select("sql", error_class(F.col("success"), F.col("error"), F.col("is_empty"), F.lit(1), F.lit(1)).alias("c")).collect()
    assert {r.sql: r.c for r in got} == dict(texts)


def test_batch_timeout(spark):
    spark.range(1).createOrReplaceTempView("slow_t")
    slow = "SELECT sum(a.id * b.id) FROM range(3000000) a, range(3000000) b"
    record = batch.run_one(spark, slow, timeout_sec=3)
    assert record[0] is False and record[2] < 60


def test_json_files(spark, tmp_path):
    (tmp_path / "1_context.json").write_text('[{"question_id": "1", "a": "x"}]')
    (tmp_path / "2_context.json").write_text('[{"question_id": "2", "a": "y"}]')
    (tmp_path / "1_repaired.json").write_text('[{"question_id": "1", "b": 5}]')
    both = jsonio.read_question_files(
        spark, f"{tmp_path}/*_context.json", "question_id string, a string", f"{tmp_path}/*_repaired.json", "question_id string, b int, c string"
    ).collect()
    assert [(r.question_id, r.a, r.b, r.c) for r in both] == [("1", "x", 5, None)]
    (tmp_path / "lines.jsonl").write_text('{"a": "é"}\n\n{"b": 1}\n')
    assert sorted(str(r.a) for r in jsonio.read_json_lines(spark, str(tmp_path / "lines.jsonl"), "a string").collect()) == ["None", "é"]
    df = spark.createDataFrame([("é", None)], "a string, b int")
    jsonio.write_json_lines(df, str(tmp_path / "out" / "deep"))
    assert jsonio.read_json_lines(spark, str(tmp_path / "out" / "deep"), df.schema).collect() == df.collect()
    kept = jsonio.write_stage(df, str(tmp_path / "stage"))
    assert kept.collect() == df.collect()


def test_model_steps(spark):
    q = spark.createDataFrame([("1", "db", "what?", "x means y"), ("2", "db", "who?", "")], "question_id string, db_id string, question string, evidence string")
    intents = prompts.intents_from_answers(answer_prompts(prompts.intent_prompts(q), constant_model('{"operation": "count", "literals": ["x"]}'), ["question_id"])).collect()
    assert {(r.intent.operation, r.intent.literals[0], r.parse_error) for r in intents} == {("count", "x", False)}
    assert all(r.parse_error for r in prompts.intents_from_answers(answer_prompts(prompts.intent_prompts(q), constant_model(), ["question_id"])).collect())
    columns = spark.createDataFrame([("1", ["t.a"])], "question_id string, columns array<string>")
    asked = prompts.constraint_prompts(q, columns)
    assert asked.count() == 1  # no evidence, no question to the model

    def answers(text):
        return prompts.constraints_from_answers(asked.withColumn("answer", F.lit(text))).first().constraints

    assert answers("[]") == [] and answers('{"column": "t.a", "confidence": 0.5}')[0].confidence == 0.5
    assert answers("sorry")[0].parse_error and answers("sorry")[0].raw_response == "sorry"
    profile = spark.createDataFrame([("db", "t", "a", "", "")], "db_id string, table_name string, column_name string, short_description string, possible_semantic_type string")
    told = prompts.merge_summaries(profile, answer_prompts(prompts.summary_prompts(profile), constant_model('{"possible_semantic_type": "name"}'), ["column_name"])).first()
    assert told.possible_semantic_type == "name" and told.raw_response is None


def test_one_failing_prompt_leaves_the_others(spark):
    def model(texts, temperatures):
        if any("bad" in t for t in texts):
            raise ValueError("no answer to this")
        return [t.upper() for t in texts]

    asked = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}", 0.0) for i in range(6)], "i int, prompt string, temperature double")
    got = {r.i: (r.answer, r.answer_error) for r in answer_prompts(asked, model, ["i"], partitions=1).collect()}
    assert got[3] == (None, "ValueError: no answer to this") and got[4] == ("P4", None) and len(got) == 6


def test_repair_rounds(spark):
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("repair_t")
    rows = [("1", "db", "1_cand_0", 0, "s", "p", "SELECT k FROM repair_t"), ("1", "db", "1_cand_1", 1, "s", "p", "SELECT z FROM repair_t"),
            ("1", "db", "1_cand_2", 2, "s", "p", "SELECT k FROM repair_t WHERE k > 9")]
    made = spark.createDataFrame(rows, "question_id string, db_id string, candidate_id string, pos int, source string, prompt_id string, sql string")
    ddl = spark.createDataFrame([("db", "CREATE TABLE repair_t (k int)")], "db_id string, ddl string")

    def model(texts, temperatures):
        return ["SELECT k FROM repair_t WHERE k > 9" if "SELECT z" in t else "SELECT max(k) FROM repair_t " for t in texts]

    done = {r.candidate_id: r for r in repair(made, ddl, model, batch.run_batch).collect()}
    assert [len(done[f"1_cand_{i}"].repair_history) for i in range(3)] == [0, 2, 1]
    first = done["1_cand_1"].repair_history[0]
    assert (first.round, first.diagnosis, first.original_sql) == (1, "column_missing", "SELECT z FROM repair_t")
    assert done["1_cand_1"].sql == "SELECT max(k) FROM repair_t" and done["1_cand_1"].exec.success
    off = repair(made, ddl, model, batch.run_batch, use_repair=False).collect()
    assert all(r.repair_history == [] for r in off)


def test_families():
    assert sum(f.count for f in prompts.FAMILIES) == 15
    some = prompts.active_families({"icl_generator": False}, {"simple_generator": 0, "reasoning_generator": 1})
    assert [(f.source, f.count) for f in some][0] == ("reasoning_generator", 1) and len(some) == 4


def test_value_semantics(spark):
    df = spark.createDataFrame([(7, 2, "12abc"), (-7, 2, "x"), (1, 0, None)], "a int, b int, t string")
    rows = df.select(int_div(F.col("a"), F.col("b")), ratio(F.col("a"), F.col("b")), loose_real(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(3, 3.5, 12.0), (-3, -3.5, 0.0), (None, None, None)]


@pytest.mark.parametrize("name", ["link_values", "rank_columns", "final_selection", "pairwise_rows", "candidate_pool", "ablation_accuracy", "preference_pairs"])
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    from tools import check

    con = duckdb.connect()
    for file in sorted(__import__("pathlib").Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    assert check.compare(spark, con, name, sf_dir)[0].startswith("ok")


def test_dataset_run(spark, sf_dir):
    from tablesage.plans.registered import QUERIES

    rows = QUERIES["dataset_run_rule_based"](spark, sf_dir).collect()
    assert len(rows) == 150 and all(r.predicted_sql.startswith("SELECT") for r in rows)
    assert all(r.num_original_candidates >= 15 for r in rows)


def test_run_starts_again_where_it_stopped(spark, sf_dir, tmp_path):
    """A run that is lost after its second stage is started again: no prompt of the first is asked once more."""
    import json
    import uuid

    from tablesage.operators.inference import JUDGE_TASK
    from tablesage.plans.dataset_run import RunConfig, run_dataset
    from tablesage.plans.evaluation_queries import workload_model
    from tablesage.plans.inputs import DB, questions, tables_of

    log = tmp_path / "asked"
    log.mkdir()

    def model(texts, temperatures):
        (log / uuid.uuid4().hex).write_text(json.dumps([f"{t}#{x}" for t, x in zip(texts, temperatures)]))
        return ["A" if text.startswith(JUDGE_TASK) else answer for text, answer in zip(texts, workload_model(texts, temperatures))]

    def asked():
        return [p for f in log.iterdir() for p in json.loads(f.read_text())]

    def lost(queries):
        raise RuntimeError("the driver is lost")

    tables = tables_of(spark, sf_dir, ["part", "customer"])
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    settings = dict(config=RunConfig(selector="model", limit=4), record=str(tmp_path / "record"))
    with pytest.raises(RuntimeError, match="lost"):
        run_dataset(questions(spark, sf_dir), tables, DB, model, run=lost, **settings)
    before = asked()
    assert len(before) == 4 + 4 + 4 * 15  # intents, constraints, candidates
    first = sorted(map(tuple, run_dataset(questions(spark, sf_dir), tables, DB, model, **settings).collect()))
    after = asked()
    assert len(after) > len(before) and not set(before) & set(after[len(before):]) - set(before)
    assert sum(p in set(before) for p in after) == len(before)
    assert any(p.startswith(JUDGE_TASK) for p in after)
    rows = run_dataset(questions(spark, sf_dir), tables, DB, model, **settings).collect()
    logs = {again: spark.read.parquet(str(tmp_path / "record" / "comparisons" / ("second" if again else "first"))) for again in {r.refined for r in rows}}
    for r in rows:  # a record has as many comparisons as the log of its selection
        assert r.num_comparisons == logs[r.refined].filter(F.col("question_id") == r.question_id).count() > 0
    assert all(log.columns == ["question_id", "round", "a_candidate_id", "b_candidate_id", "winner", "confidence"] for log in logs.values())
    second = sorted(map(tuple, rows))
    assert second == first and len(asked()) == len(after)


def test_recorded_answers(spark, tmp_path):
    from tablesage.operators.inference import RecordedModel

    def model(texts, temperatures):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    def ask(rows, waves=3):
        df = spark.createDataFrame(rows, "k int, prompt string, temperature double")
        return {r.k: (r.answer, r.answer_error) for r in answer_prompts(df, RecordedModel(model, str(tmp_path / "a"), waves), ["k"], stage="s").collect()}

    assert ask([(1, "x", 0.1), (2, "bad", 0.1), (3, "x", 0.1)]) == {1: ("X", None), 2: (None, "ValueError: no"), 3: ("X", None)}

    def model(texts, temperatures):  # noqa: F811
        return [t + "!" for t in texts]

    assert ask([(1, "x", 0.1), (2, "bad", 0.1), (3, "y", 0.1), (4, "x", 0.1), (1, "x", 0.1)]) == {1: ("X", None), 2: ("bad!", None), 3: ("y!", None), 4: ("x!", None)}


def test_texts_of_one_database_leave_rows_where_they_are(spark):
    """All rows have one database: they are not gathered in one task to meet its schema."""
    from tablesage.operators.catalog_join import join_texts
    from tablesage.session import stable

    texts = stable(spark.createDataFrame([("db", "CREATE TABLE t (a int);"), (None, "x")], "db_id string, ddl string"))
    rows = spark.range(40, numPartitions=4).select(F.col("id").alias("question_id"), F.when(F.col("id") % 10 > 0, "db").alias("db_id"))
    met = join_texts(rows, texts, "ddl", ["question_id"]).withColumn("task", F.spark_partition_id())
    assert met.select("task").distinct().count() == 4
    assert met.where("ddl IS NULL").count() == 4 and met.count() == 40


def test_prompts_are_left_out_where_nobody_reads_them(spark, tmp_path):
    from tablesage.operators.inference import RecordedModel

    asked = spark.createDataFrame([(i, f"p{i}", 0.1) for i in range(5)], "i int, prompt string, temperature double")
    model = lambda prompts, temperatures: [p + "!" for p in prompts]
    for asker in (model, RecordedModel(model, str(tmp_path / "answers"))):
        found = answer_prompts(asked, asker, ["i"], with_prompt=False)
        assert "prompt" not in found.columns and {(r.i, r.answer) for r in found.collect()} == {(i, f"p{i}!") for i in range(5)}


def test_repair_prompt_tokens(spark):
    """The estimate from the parts is the whole prompt's, odd white space and nulls included."""
    from tablesage.functions.text import token_estimate, word_count

    texts = ["", " ", "a", "SELECT  1\n", " a   b", "\tx "]
    rows = [(s, e, d) for s in [*texts, None] for e in texts for d in texts]
    df = spark.createDataFrame(rows, "s string, e string, d string")
    whole = token_estimate(prompts.repair_prompt(F.col("s"), F.col("e"), F.col("d")))
    parts = prompts.repair_prompt_tokens(F.col("s"), F.col("e"), word_count(F.col("d")))
    assert df.select(whole.alias("w"), parts.alias("p")).where("NOT w <=> p").isEmpty()
