"""Evaluation: accuracy, pass@k, cost, latency, error classes, ablation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesage.operators.compare import diagnose
from tablesage.operators.selection import execution_groups, judged_tournament, merit, packed, rule_level
from tablesage.session import stable

# Prices per 1000 tokens in dollars, and the k of pass@k.
INPUT_PRICE, OUTPUT_PRICE = 0.003, 0.015
PASS_KS = (1, 3, 5, 10)


def judged_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions (question_id, pred_key, pred_rows) against gold (question_id, gold_key, gold_rows).

    A key is the digest of a result, NULL when there is none. A prediction without gold has
    status ``missing_gold`` and is wrong; so is one without a result.
    """
    known = gold.withColumn("_known", F.lit(True))
    correct = F.coalesce(F.col("pred_key") == F.col("gold_key"), F.lit(False))
    status = F.when(F.col("_known").isNull(), F.lit("missing_gold")).otherwise(F.lit("evaluated"))
    return predictions.join(known, "question_id", "left").withColumns({"correct": correct, "status": status}).drop("_known")


def accuracy(judged: DataFrame) -> DataFrame:
    """(total, correct, accuracy); no predictions give 0."""
    right = F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0))
    total = F.count(F.lit(1))
    return judged.agg(
        total.alias("total"), right.alias("correct"), F.coalesce(F.try_divide(right, total), F.lit(0.0)).alias("accuracy")
    )


def pass_at_k(candidates: DataFrame, ks: tuple[int, ...] = PASS_KS) -> DataFrame:
    """(total_questions, oracle_accuracy, pass_at_k...): some of the first k candidates is correct."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    per_question = candidates.groupBy("question_id").agg(
        F.bool_or(right).alias("any"), *[F.bool_or(right & (F.col("pos") < k)).alias(f"k{k}") for k in ks]
    )

    def share(name: str) -> Column:
        return F.coalesce(F.avg(F.col(name).cast("double")), F.lit(0.0))

    return per_question.agg(
        F.count(F.lit(1)).alias("total_questions"), share("any").alias("oracle_accuracy"),
        *[share(f"k{k}").alias(f"pass_at_{k}") for k in ks],
    )


def _history_sum(field_name: str) -> Column:
    return F.aggregate(
        F.coalesce(F.transform("repair_history", lambda r: F.coalesce(r[field_name], F.lit(0)).cast("double")), F.array().cast("array<double>")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def cost_details(predictions: DataFrame, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> DataFrame:
    """(question_id, input_tokens, output_tokens, estimated_cost_usd) from generation and repair tokens."""
    spent = predictions.select(
        "question_id",
        (F.coalesce("input_tokens", F.lit(0)) + _history_sum("input_tokens").cast("long")).alias("input_tokens"),
        (F.coalesce("output_tokens", F.lit(0)) + _history_sum("output_tokens").cast("long")).alias("output_tokens"),
    )
    cost = F.col("input_tokens") / 1000 * input_price + F.col("output_tokens") / 1000 * output_price
    return spent.withColumn("estimated_cost_usd", F.round(cost, 6))


def cost_summary(details: DataFrame, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> DataFrame:
    tokens_in = F.coalesce(F.sum("input_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.sum("output_tokens"), F.lit(0))
    cost = tokens_in / 1000 * input_price + tokens_out / 1000 * output_price
    return details.agg(
        F.count(F.lit(1)).alias("total_questions"), tokens_in.alias("total_input_tokens"), tokens_out.alias("total_output_tokens"),
        F.round(cost, 4).alias("total_cost_usd"),
        F.round(cost / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("avg_cost_per_question_usd"),
    )


def latency_details(predictions: DataFrame) -> DataFrame:
    """(question_id, generation, execution, repair and total seconds)."""
    spent = predictions.select(
        "question_id",
        F.coalesce("generation_time_sec", F.lit(0.0)).alias("generation_time_sec"),
        F.coalesce("runtime_sec", F.lit(0.0)).alias("execution_time_sec"),
        _history_sum("repair_time_sec").alias("repair_time_sec"),
    )
    return spent.withColumn("total_time_sec", F.col("generation_time_sec") + F.col("execution_time_sec") + F.col("repair_time_sec"))


def latency_summary(details: DataFrame) -> DataFrame:
    """Totals over decimals, so that the order of addition does not show in the result."""
    seconds = F.col("total_time_sec").cast("decimal(28,9)")
    total = F.coalesce(F.sum(seconds), F.lit(0)).cast("double")
    zero = F.lit(0.0)
    return details.agg(
        F.count(F.lit(1)).alias("total_questions"), total.alias("total_time_sec"),
        F.coalesce(F.try_divide(total, F.count(F.lit(1))), zero).alias("avg_time_per_question_sec"),
        F.coalesce(F.max("total_time_sec"), zero).alias("max_time_sec"), F.coalesce(F.min("total_time_sec"), zero).alias("min_time_sec"),
    )


def error_class(success: Column, error: Column, is_empty: Column, pred_rows: Column, gold_rows: Column) -> Column:
    failed, found = ~F.coalesce(success, F.lit(False)), diagnose(F.coalesce(error, F.lit("")))
    return (
        F.when(failed & (found == "table_missing"), F.lit("wrong_table"))
        .when(failed & (found == "column_missing"), F.lit("wrong_column"))
        .when(failed & ((found == "syntax_error") | F.lower(F.coalesce(error, F.lit(""))).contains("syntax")), F.lit("syntax_error"))
        .when(failed, F.lit("execution_error"))
        .when(F.coalesce(is_empty, F.lit(False)), F.lit("empty_result"))
        .when(pred_rows != gold_rows, F.lit("wrong_row_count"))
        .otherwise(F.lit("wrong_values"))
    )


def error_details(judged: DataFrame) -> DataFrame:
    """Wrong predictions with their ``category``."""
    category = error_class(F.col("success"), F.col("error"), F.col("is_empty"), F.col("pred_rows"), F.col("gold_rows"))
    return judged.filter(~F.col("correct")).withColumn("category", category)


def error_distribution(details: DataFrame) -> DataFrame:
    return details.groupBy("category").agg(F.count(F.lit(1)).alias("errors")).orderBy(F.col("errors").desc(), "category")


# The ablation variants and what each changes.
@dataclass(frozen=True)
class Variant:
    name: str
    method: str = "trained_prm"
    without_sources: tuple[str, ...] = field(default_factory=tuple)
    use_repair: bool = True
    use_refinement: bool = True
    hidden: tuple[str, ...] = field(default_factory=tuple)

    @property
    def setting(self) -> tuple:
        """All that the variant changes: every field but its name."""
        return tuple(getattr(self, f.name) for f in fields(self) if f.name != "name")


# Methods whose winner a judge decides that reads the candidates; the others need the candidates only.
JUDGED = ("llm_pairwise", "trained_prm", "prm_llm_tiebreaker", "no_execution")
VARIANTS = [
    Variant("A0_majority_voting", "majority_voting"),
    Variant("A1_execution_grouping", "execution_grouping"),
    Variant("A2_rule_selector", "rule_based"),
    Variant("A3_llm_pairwise", "llm_pairwise"),
    Variant("A4_trained_prm"),
    Variant("A5_prm_llm_tiebreaker", "prm_llm_tiebreaker"),
    Variant("A6_prm_hardcase"),
    Variant("A7_prm_no_execution", "no_execution"),
    Variant("A8_prm_no_evidence", hidden=("evidence",)),
    Variant("A9_prm_no_matched_values", hidden=("matched_values",)),
    Variant("full"),
    Variant("wo_evidence_focused_gen", without_sources=("evidence_focused_generator",)),
    Variant("wo_join_focused_gen", without_sources=("join_focused_generator",)),
    Variant("wo_repair", use_repair=False),
    Variant("wo_hard_case", use_refinement=False),
]


def apply_overrides(config: dict, overrides: dict) -> dict:
    """A copy of a nested configuration with dotted keys set."""
    changed = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items()}
    for dotted, value in overrides.items():
        *path, last = dotted.split(".")
        target = changed
        for part in path:
            target[part] = dict(target.get(part) or {})
            target = target[part]
        target[last] = value
    return changed


def ablation_accuracy(candidates: DataFrame, variants: list[Variant] | None = None) -> DataFrame:
    """(variant, total, correct, accuracy): one selection per question and variant, in one job.

    Candidates are generated once with every family on; a variant only decides which of them
    take part and how one is chosen. So all variants are conditional aggregates of the same
    two groupings, instead of one copy of the candidates per variant. Under the level judge a
    round robin is won by the highest level, so its winner needs no scores here. Expects flat
    candidates with ``is_correct``; a question without any allowed candidate is wrong.

    No judge and no refinement is known here: all methods of a judge stand for the level judge, and variants that differ
    in the judge, in what it reads or in refinement come out equal. :func:`variant_accuracy` tells them apart.
    """
    variants = variants or VARIANTS
    chosen, shared = _level_choices(candidates, variants)
    totals = chosen.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in shared.values()])
    rows = F.array(
        *[
            F.struct(F.lit(v.name).alias("variant"), F.col(shared[(v.method, v.without_sources, v.use_repair)]).alias("correct"))
            for v in variants
        ]
    )
    return totals.select("total", F.inline(rows)).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def _takes_part(without: tuple[str, ...], use_repair: bool) -> Column:
    allowed = ~F.col("source").isin(list(without)) if without else F.lit(True)
    # Without repair, a candidate that runs only thanks to it does not take part.
    return allowed if use_repair else allowed & (F.col("num_repairs") == 0)


def _level_choices(candidates: DataFrame, variants: list[Variant]) -> tuple[DataFrame, dict[tuple, str]]:
    """(question_id, one column per key with 1 where the choice is right), and the columns by (method, sources, repair)."""
    shared: dict[tuple, str] = {}
    for v in variants:
        shared.setdefault((v.method, v.without_sources, v.use_repair), f"v{len(shared)}")
    worth = merit(F.col("source"), F.col("num_repairs"))
    group_aggs, question_aggs = [], []
    for (method, without, use_repair), name in shared.items():
        allowed = _takes_part(without, use_repair)
        order = packed(worth, F.col("pos"))
        taken = F.when(allowed, order)
        # The right answer travels in the lowest bit, the order above it.
        bit = (F.col("is_correct") & F.col("success")).cast("long")
        group_aggs += [
            F.max(taken * 2 + bit).alias(f"{name}_best"),
            F.count(F.when(allowed, 1)).alias(f"{name}_size"),
            F.min(F.when(allowed, F.col("pos"))).alias(f"{name}_first"),
            F.max(F.when(allowed, rule_level(F.col("success"), F.col("is_empty"), F.lit(0)))).alias(f"{name}_level"),
        ]
        best, right = F.shiftright(F.col(f"{name}_best"), 1), F.col(f"{name}_best").bitwiseAND(F.lit(1))
        group_merit = F.shiftright(best, 40)
        if method == "majority_voting":
            score = F.col(f"{name}_size")
        elif method in ("execution_grouping", "no_execution"):
            score = group_merit
        else:
            score = F.col(f"{name}_level") + group_merit
        place = F.struct(score.alias("s"), (-F.col(f"{name}_first")).alias("p"), right.alias("r"))
        question_aggs.append(F.max(F.when(F.col(f"{name}_size") > 0, place))["r"].alias(name))
    chosen = (
        candidates.groupBy("question_id", "result_key").agg(*group_aggs).groupBy("question_id").agg(*question_aggs)
    )
    return chosen, shared


def told_apart(variants: list[Variant] | None = None) -> list[Variant]:
    """The first variant of each setting: A6 and full change nothing that A4 does not."""
    kept: dict[tuple, Variant] = {}
    for v in variants or VARIANTS:
        kept.setdefault(v.setting, v)
    return list(kept.values())


def variant_accuracy(candidates: DataFrame, comparisons: DataFrame, refined: DataFrame, variants: list[Variant] | None = None) -> DataFrame:
    """(variant, total, correct, accuracy) of the variants that their settings tell apart.

    ``comparisons`` is (variant, question_id, a_candidate_id, b_candidate_id, winner, confidence): what the judge of a
    variant said of representatives of distinct results; those of other candidates do not count. ``refined`` is
    (variant, question_id, is_correct), a row for each selection that refinement replaced. A variant whose method needs
    a judge and has no comparisons has NULL as ``correct``. A question without any allowed candidate is wrong.
    """
    variants = told_apart(variants)
    judged, plain = [v for v in variants if v.method in JUDGED], [v for v in variants if v.method not in JUDGED]
    questions = candidates.select("question_id").distinct()
    outcomes = []
    if plain:
        chosen, shared = _level_choices(candidates, plain)
        each = [F.struct(F.lit(v.name).alias("variant"), F.col(shared[(v.method, v.without_sources, v.use_repair)]).alias("correct")) for v in plain]
        outcomes.append(chosen.select("question_id", F.inline(F.array(*each))))
    if judged:
        outcomes.append(_judged_choices(candidates, comparisons, judged))
    if renewing := [v.name for v in variants if v.use_refinement]:
        renewed = refined.filter(F.col("variant").isin(renewing)).join(questions, "question_id", "left_semi")
        outcomes.append(renewed.select("question_id", "variant", F.coalesce("is_correct", F.lit(False)).cast("long").alias("correct")).withColumn("_after", F.lit(1)))
    rows = outcomes[0]
    for more in outcomes[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    last = rows.groupBy("variant", "question_id").agg(F.max(F.struct(F.coalesce("_after", F.lit(0)), F.coalesce("correct", F.lit(0)).alias("c")))["c"].alias("correct")) if renewing else rows
    sums = last.groupBy("variant").agg(F.sum("correct").alias("correct"))
    listed = questions.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.inline(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.lit(v.method in JUDGED).alias("_judged")) for v in variants]))
    )
    heard = comparisons.select("variant", F.lit(True).alias("_heard")).distinct()
    found = F.when(~F.col("_judged") | F.col("_heard"), F.coalesce("correct", F.lit(0)))
    return listed.join(sums, "variant", "left").join(heard, "variant", "left").select(
        "variant", "total", found.alias("correct")
    ).withColumn("accuracy", F.when(F.col("correct").isNotNull(), F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))))


def _judged_choices(candidates: DataFrame, comparisons: DataFrame, judged: list[Variant]) -> DataFrame:
    """(question_id, variant, correct): winners of the judged tournaments; variants with the same candidates share their groups."""
    pools: dict[tuple, list[str]] = {}
    for v in judged:
        pools.setdefault((v.without_sources, v.use_repair), []).append(v.name)
    names = F.array(*[F.array(*map(F.lit, x)) for x in pools.values()])
    taken = F.array(*[F.when(_takes_part(*key), F.lit(i)) for i, key in enumerate(pools)])
    pooled = candidates.withColumn("_pool", F.explode(F.filter(taken, lambda i: i.isNotNull())))
    right = F.max_by((F.col("is_correct") & F.col("success")).cast("long"), packed(merit(F.col("source"), F.col("num_repairs")), F.col("pos")))
    groups = execution_groups(pooled.withColumn("question_id", F.struct("_pool", "question_id")), [right.alias("correct")])
    # From here on, a question of a variant is a question of its own.
    each = groups.withColumn("variant", F.explode(names[F.col("question_id._pool")]))
    each = stable(each.withColumn("question_id", F.struct("variant", F.col("question_id.question_id").alias("question_id"))).drop("variant"))
    said = comparisons.withColumn("question_id", F.struct("variant", "question_id"))
    for side in ("a", "b"):
        said = said.join(each.select("question_id", F.col("candidate_id").alias(f"{side}_candidate_id")), ["question_id", f"{side}_candidate_id"], "left_semi")
    first = judged_tournament(each, said).filter("rank = 1")
    return first.select("question_id.question_id", "question_id.variant", "correct")
