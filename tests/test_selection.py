import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablesage.operators import hard_cases, metrics, selection, training_sets
from tablesage.operators.numbering import Along, numbered
from tablesage.operators.ordering import positions
from tablesage.operators.preference import PreferenceModel
from tablesage.operators.prompts import judge_winner

SCHEMA = (
    "question_id string, candidate_id string, pos int, source string, num_repairs int, success boolean, row_count bigint,"
    " column_count int, is_empty boolean, result_key string, sql string, is_correct boolean, runtime_sec double"
)


def cand(q, pos, key, source="simple_generator", repairs=0, correct=False, empty=False, runtime=1.0):
    ok = key != "failed"
    return (q, f"{q}_{pos}", pos, source, repairs, ok, (0 if empty else 3) if ok else None, 1 if ok else None,
            empty if ok else None, key, f"SELECT {pos}", correct, runtime)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_all_failed_is_one_group_and_not_hard(spark):
    rows = frame(spark, [cand("q", i, "failed") for i in range(4)])
    groups = selection.execution_groups(rows)
    assert groups.count() == 1
    record = hard_cases.hard_cases(selection.select_final(rows)).first()
    assert record.best_candidate_id == "q_0" and record.hard_case is False and float(record.best_score) == 0.0
    assert record.num_original_candidates == 4 and record.num_representatives == 1


def test_representative_and_votes(spark):
    rows = frame(spark, [
        cand("q", 0, "x", "simple_generator"), cand("q", 1, "x", "reasoning_generator", repairs=1),
        cand("q", 2, "x", "icl_generator"), cand("q", 3, "y", "evidence_focused_generator"),
    ])
    reps = {r.result_key: r for r in selection.execution_groups(rows).collect()}
    assert reps["x"].candidate_id == "q_1"  # 4 - 1 equals 3 - 0, the earlier stays
    assert reps["x"].merit == 3 and reps["x"].pos == 1 and reps["x"].first_pos == 0
    assert selection.majority_vote(selection.execution_groups(rows)).first().candidate_id == "q_1"
    assert selection.grouping_select(selection.execution_groups(rows)).first().candidate_id == "q_3"


def test_negative_merit_unpacks(spark):
    rows = frame(spark, [cand("q", 5, "x", "unknown", repairs=2)])
    rep = selection.execution_groups(rows).first()
    assert (rep.merit, rep.pos) == (-2, 5)


def round_robin(levels):
    scores = [0.0] * len(levels)
    for a, b in itertools.combinations(range(len(levels)), 2):
        if levels[a] == levels[b]:
            scores[a] += 0.25
            scores[b] += 0.25
        else:
            scores[a if levels[a] > levels[b] else b] += 0.8
    return scores


def test_level_tournament_equals_pairs(spark):
    sources = list(selection.SOURCE_PRIORITY) + ["other"]
    rows = [cand("q", i, f"k{i}", sources[i % 7], repairs=i % 3, empty=i % 5 == 0) for i in range(20)]
    groups = selection.execution_groups(frame(spark, rows))
    ranked = selection.level_tournament(groups)
    got = {r.pos: r for r in ranked.collect()}
    levels = [got[i].level for i in range(20)]
    wanted = round_robin(levels)
    assert all(abs(float(got[i].score) - wanted[i]) < 1e-9 for i in range(20))
    order = sorted(range(20), key=lambda i: (-round(wanted[i], 6), i))
    assert [got[i].rank for i in order] == list(range(1, 21))
    # The same scores come out of judged pairs.
    schedule = selection.judge_schedule(ranked)
    assert schedule.columns == ["question_id", "round", "a_candidate_id", "b_candidate_id"]
    pairs = selection.with_payload(schedule, ranked, ["level"])
    winner = training_sets.winner_of(F.col("a_level"), F.col("b_level"))
    judged = pairs.withColumn("winner", winner).withColumn("confidence", F.when(F.col("winner") == "tie", 0.5).otherwise(0.8))
    assert judged.count() == 190
    again = {r.pos: (float(r.score), r.rank) for r in selection.judged_tournament(groups, judged).collect()}
    assert again == {i: (float(got[i].score), got[i].rank) for i in range(20)}


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_and_ranks_in_any_order(spark, seed):
    """Most rows share one value; ranges are many, so runs of equals go on over several borders."""
    draw = random.Random(seed)
    rows = [(i, draw.choice("abbbbbb"), None if draw.random() < 0.02 else 7.0 if draw.random() < 0.9 else draw.choice([-1e9, 0.5, 8.0, 9.0, 1e300])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for by, descending in (([], True), (["g"], True), (["g"], False)):
            order = [Along(F.col("v"), descending=descending)]
            level = lambda v: ((v is None, -(v or 0)) if descending else (v is not None, v or 0))
            ranked = {r.i: r.place for r in positions(df, by, order, "place", start=1, ties=True).collect()}
            placed = positions(df, by, order, "at", total="n").collect()
            for i, g, v in rows:
                rivals = [r for r in rows if not by or r[1] == g]
                assert ranked[i] == 1 + sum(level(r[2]) < level(v) for r in rivals)
            for group in "ab" if by else "x":
                own = sorted((r.at, level(r.v)) for r in placed if not by or r.g == group)
                assert [at for at, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
            assert {r.n for r in placed} == {600}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_nobody_plays_twice_in_a_round(spark):
    rows = [(f"q{n}", f"q{n}_{i}", 3 * i) for n in (1, 2, 3, 6, 7, 12) for i in range(n)]
    schedule = selection.judge_schedule(spark.createDataFrame(rows, "question_id string, candidate_id string, first_pos long")).collect()
    for n in (1, 2, 3, 6, 7, 12):
        own = [r for r in schedule if r.question_id == f"q{n}"]
        assert {(r.a_candidate_id, r.b_candidate_id) for r in own} == set(itertools.combinations([f"q{n}_{i}" for i in range(n)], 2))
        assert len(own) == n * (n - 1) // 2 and {r.round for r in own} <= set(range(n - 1 + n % 2))
        for number in {r.round for r in own}:
            players = [p for r in own if r.round == number for p in (r.a_candidate_id, r.b_candidate_id)]
            assert len(players) == len(set(players))


def test_numbering_survives_one_big_group(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("g"), "id")
    got = numbered(rows, ["g"], [Along(F.floor(F.col("id") / 64))], [F.col("id")], "at")
    assert got.filter("g = 0 AND at <> id").count() == 0 and got.filter("g > 0 AND at <> 0").count() == 0
    back = numbered(rows, [], [Along(F.floor(F.col("id") / 64), descending=True)], [F.col("id").desc()], "at")
    assert back.filter("at <> 999 - id").count() == 0


def test_sampled_pairs(spark):
    counts = spark.createDataFrame([("one", 1), ("two", 2), ("six", 6), ("seven", 7), ("big", 100_000)], "question_id string, n bigint")
    drawn = training_sets.sampled_pair_positions(counts)
    got = {}
    for r in drawn.collect():
        assert 0 <= r.pos_a < r.pos_b
        got.setdefault(r.question_id, set()).add((r.pos_a, r.pos_b))
    assert "one" not in got and got["two"] == {(0, 1)}
    assert got["six"] == set(itertools.combinations(range(6), 2))
    assert len(got["seven"]) == 20 and len(got["big"]) == 20
    assert all(b < 100_000 for _, b in got["big"])


def test_every_pair_number_is_turned_into_its_positions(spark):
    counts = spark.createDataFrame([("q", 60)], "question_id string, n bigint")
    got = {(r.pos_a, r.pos_b) for r in training_sets.sampled_pair_positions(counts, k=5000).collect()}
    assert got == set(itertools.combinations(range(60), 2))


def test_preference_pairs_cover_all_pairs(spark):
    rows = [("q", f"c{i}", i, f"s{i % 4}" if i % 2 else "icl_generator", i % 3) for i in range(30)]
    labeled = spark.createDataFrame(rows, "question_id string, candidate_id string, pos int, source string, label int")
    pairs = training_sets.preference_pairs(labeled)
    assert pairs.agg(F.sum("n_pairs")).first()[0] == 30 * 29 // 2
    ties = sum(1 for a, b in itertools.combinations(range(30), 2) if a % 3 == b % 3)
    assert pairs.filter("winner = 'tie'").agg(F.sum("n_pairs")).first()[0] == ties
    assert training_sets.preference_pairs(labeled.limit(1)).count() == 0


def test_scores_rewards_and_listwise(spark):
    rows = frame(spark, [
        cand("q", 0, "x", correct=True, runtime=12.0), cand("q", 1, "y"), cand("q", 2, "z", empty=True), cand("q", 3, "failed"),
        cand("q", 4, "x", correct=True, runtime=2.5), cand("q", 5, "x", correct=True, runtime=2.5),
    ])
    scores = {r.pos: r.score for r in training_sets.with_quality_score(rows).collect()}
    assert scores == {0: 2.0, 1: 1.5, 2: 1.0, 3: 0.0, 4: 2.75, 5: 2.75}
    lists = training_sets.listwise_rows(rows, ["candidate_id"]).first()
    assert lists.best_candidate_id == "q_4" and [c.candidate_id for c in lists.candidates] == [f"q_{i}" for i in range(6)]
    questions = spark.createDataFrame([("q", "db", "what?", "")], "question_id string, db_id string, question string, evidence string")
    pool = training_sets.rollout_pool(questions, rows).first()
    assert pool.reward_map == {"q_0": 1.0, "q_1": 0.2, "q_2": 0.2, "q_3": 0.0, "q_4": 1.0, "q_5": 1.0}
    assert pool.prompt.startswith("Question: what?\nEvidence: None\n")


def test_judge_words(spark):
    words = ["TIE", "SQL B", "BECAUSE", "", " a ", "xyz", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[1] for r in df.select("i", judge_winner(F.col("w"))).orderBy("i").collect()]
    assert got == ["tie", "B", "A", "tie", "A", "tie", "tie"]


def hard(spark, **fields):
    base = dict(question_id="q", best_score=2.0, second_score=1.0, all_top_empty=False, num_representatives=3, final_sql="SELECT Zip FROM s WHERE k = 'Fresno'")
    row = base | fields
    df = spark.createDataFrame([tuple(row.values())], "question_id string, best_score double, second_score double, all_top_empty boolean, num_representatives int, final_sql string")
    c = spark.createDataFrame([("q", [("s.zip", "FRESNO", None), (None, None, None), ("x.y", "z", True)])],
                              "question_id string, constraints array<struct<column:string,value:string,parse_error:boolean>>")
    return hard_cases.hard_cases(df, c).first().reason


def test_hard_case_reasons(spark):
    assert hard(spark) is None
    assert hard(spark, second_score=1.5) is None  # a margin of exactly 0.5 decides
    assert hard(spark, second_score=1.6) == "low_margin"
    assert hard(spark, all_top_empty=True) == "all_empty"
    assert hard(spark, final_sql="SELECT 1") == "constraint_not_covered"
    assert hard(spark, num_representatives=1, all_top_empty=True) is None


def test_metrics_edges(spark):
    rows = frame(spark, [cand("q", 0, "x"), cand("q", 1, "x", correct=True), cand("r", 0, "failed")])
    found = metrics.pass_at_k(rows, (1, 50)).first()
    assert (found.oracle_accuracy, found.pass_at_1, found.pass_at_50) == (0.5, 0.0, 0.5)
    none = spark.createDataFrame([], "question_id string, pred_key string, pred_rows bigint")
    gold = spark.createDataFrame([("q", "x", 3)], "question_id string, gold_key string, gold_rows bigint")
    assert tuple(metrics.accuracy(metrics.judged_predictions(none, gold)).first()) == (0, 0, 0.0)
    some = spark.createDataFrame([("q", "x", 3), ("s", "x", 3), ("t", None, None)], none.schema)
    judged = metrics.judged_predictions(some, gold)
    assert tuple(metrics.accuracy(judged).first())[:2] == (3, 1)
    assert judged.filter("status = 'missing_gold'").count() == 2
    assert metrics.apply_overrides({"a": {"b": 1}}, {"a.b": 2, "c.d": 3}) == {"a": {"b": 2}, "c": {"d": 3}}


def test_preference_model_learns(spark, tmp_path):
    rows = [cand("q", i, "failed" if i % 2 else f"k{i}", correct=i % 4 == 0) for i in range(24)]
    pairs = training_sets.pairwise_rows(frame(spark, rows), ["candidate_id", "source", "success", "row_count", "column_count", "num_repairs"], k=300)
    model = PreferenceModel().fit(pairs)
    model.save(str(tmp_path / "m"))
    judged = PreferenceModel.load(str(tmp_path / "m")).judge(pairs)
    clear = judged.filter("a_success AND NOT b_success")
    assert clear.count() > 0 and clear.filter("winner <> 'A'").count() == 0
    assert judged.filter("confidence < 0.3333 OR confidence > 1").count() == 0


def test_plans_have_no_pair_joins(spark, sf_dir):
    from tablesage.plans.registered import QUERIES

    for name in ["tournament_scores", "final_selection", "pairwise_rows", "preference_pairs", "link_values", "column_features", "qlog_support", "ablation_accuracy"]:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan, name


def test_variants_differ_by_judge_and_refinement(spark):
    rows = frame(spark, [
        cand("q", 0, "x", "reasoning_generator"), cand("q", 1, "y", "icl_generator", correct=True), cand("r", 0, "x", correct=True), cand("r", 1, "z"),
        cand("s", 0, "x", repairs=1, correct=True), cand("s", 1, "x", repairs=1, correct=True), cand("t", 0, "failed"),
    ])
    said = [
        ("A3_llm_pairwise", "q", "q_0", "q_1", "B", 0.8), ("A4_trained_prm", "q", "q_0", "q_1", "A", 0.8), ("A4_trained_prm", "r", "r_0", "r_1", "B", 0.8),
        ("A8_prm_no_evidence", "r", "r_0", "r_1", "A", 0.8), ("wo_hard_case", "r", "r_0", "r_1", "B", 0.8), ("wo_hard_case", "q", "q_1", "unknown", "A", 1.0),
        ("wo_repair", "q", "q_0", "q_1", "B", 0.8),
    ]
    comparisons = spark.createDataFrame(said, "variant string, question_id string, a_candidate_id string, b_candidate_id string, winner string, confidence double")
    refined = [(v, q, ok) for v in ("A4_trained_prm", "wo_hard_case", "A0_majority_voting") for q, ok in (("t", True), ("gone", True))] + [("A3_llm_pairwise", "q", False)]
    found = metrics.variant_accuracy(rows, comparisons, spark.createDataFrame(refined, "variant string, question_id string, is_correct boolean"))
    got = {r.variant: r.correct for r in found.collect()}
    assert len(got) == 13 and "full" not in got and "A6_prm_hardcase" not in got  # A4 under other names
    assert {r.total for r in found.collect()} == {4}
    assert got["A3_llm_pairwise"] == 2  # q is lost to refinement, r and s stand without a word
    assert got["A4_trained_prm"] == 2 and got["wo_hard_case"] == 1  # t comes from refinement
    assert got["A8_prm_no_evidence"] == 2 and got["wo_repair"] == 2  # without repair, s has no candidate
    assert got["A9_prm_no_matched_values"] is None and got["A5_prm_llm_tiebreaker"] is None
    assert got["A0_majority_voting"] == 3 and got["A1_execution_grouping"] == 2


def test_preference_rows_have_every_candidate(spark):
    rows = [("q", f"c{i}", i, f"s{i % 4}" if i % 2 else "icl_generator", i % 3) for i in range(30)]
    rows += [("two", "a", 0, "x", 1), ("two", "b", 1, "y", 1), ("one", "a", 0, "x", 1)]
    rows += [("hot", f"h{i}", i, "icl_generator", 2 if i == 7 else 0) for i in range(5000)]
    labeled = spark.createDataFrame(rows, "question_id string, candidate_id string, pos int, source string, label int")
    found = training_sets.preference_rows(labeled).collect()
    of = lambda q: [r for r in found if r.question_id == q]
    assert not of("one") and [(r.candidate_a, r.candidate_b, r.n_pairs) for r in of("two")] == [("a", "b", 1.0)]
    for q, n in (("q", 30), ("hot", 5000)):
        pairs = [(r.candidate_a, r.candidate_b) for r in of(q)]
        assert len(set(pairs)) == len(pairs) and all(r.pos_a < r.pos_b for r in of(q))
        assert len({c for p in pairs for c in p}) == n
        assert abs(sum(r.n_pairs for r in of(q)) - n * (n - 1) / 2) < 1e-3
    assert len(of("hot")) == 4999 + 2 * 4999  # linear
    family = {r[1]: (r[4], r[3] if r[3] == "icl_generator" else "other") for r in rows[:30]}
    met = {c: {family[d] for r in of("q") for d in (r.candidate_a, r.candidate_b) if c in (r.candidate_a, r.candidate_b) and d != c} for c in family}
    assert all(met[c] >= set(family.values()) - {family[c]} for c in family)


def test_steps_of_pairs_and_context_lists_are_made_once(spark):
    rows = [("q", f"c{i}", i, f"s{i % 4}" if i % 2 else "icl_generator", i % 3) for i in range(30)]
    pairs = training_sets.preference_rows(spark.createDataFrame(rows, "question_id string, candidate_id string, pos int, source string, label int"))
    contexts = spark.createDataFrame([("q", "db", "what?", "", [f"t.c{i}" for i in range(40)], ["a"], [], ["x = y"], ["r", "s"])],
        "question_id string, db_id string, question string, evidence string, columns array<string>, matched array<string>, constraints array<string>, joins array<string>, rules array<string>")
    told = training_sets.with_context(pairs, contexts, lambda x: F.array_join(x, ","))
    first = told.first().context
    assert first.top_columns == ",".join(f"t.c{i}" for i in range(30)) and first.business_rules == "r,s"
    assert told.count() == pairs.count()
    # Numbers are drawn per class, before candidates meet; sources that nobody reads do not travel with the pairs.
    plan = pairs.select("question_id", "candidate_a", "candidate_b", "winner")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "x_class_source" not in plan


def test_final_record_has_the_whole_ranking_beside_it(spark):
    rows = frame(spark, [cand("q", i, f"k{i}", "icl_generator" if i == 4 else "simple_generator") for i in range(6)])
    record, ranking = selection.select_ranked(rows)
    ranked = ranking.orderBy("rank").collect()
    assert [(r["rank"], r.candidate_id) for r in ranked] == [(1, "q_4"), (2, "q_0"), (3, "q_1"), (4, "q_2"), (5, "q_3"), (6, "q_5")]
    kept = record.first()
    assert kept.best_candidate_id == "q_4" and [(x.id, x.score) for x in kept.ranked] == [(r.candidate_id, r.score) for r in ranked[:3]]
