"""Choosing one candidate per question from executed candidates.

Candidates come flat: (question_id, candidate_id, pos, source, num_repairs, success,
row_count, column_count, is_empty, result_key). Everything is built from aggregates with
map-side combination; a question with very many candidates is never one task's work.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesage.functions.text import clean_sql
from tablesage.operators.numbering import Along, numbered
from tablesage.session import stable

# How far each source is trusted, and the worth of a win and of a tie.
SOURCE_PRIORITY = {
    "metadata_constrained_generator": 5,
    "evidence_focused_generator": 5,
    "reasoning_generator": 4,
    "join_focused_generator": 4,
    "icl_generator": 3,
    "simple_generator": 2,
}
WIN_CONFIDENCE = 0.8
TIE_CONFIDENCE = 0.5
SCORE = "decimal(18,6)"

# Order keys are packed into one long (merit above, earlier position wins below), so that
# the aggregates keep fixed-width buffers and stay hash aggregates.
POSITIONS = 1 << 40
POSITIONS_PER_CHUNK = 8192


def source_priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*SOURCE_PRIORITY.items())])
    return F.coalesce(F.try_element_at(table, source), F.lit(0))


def merit(source: Column, repairs: Column) -> Column:
    return (source_priority(source) - F.coalesce(repairs, F.lit(0))).cast("long")


def packed(score: Column, pos: Column) -> Column:
    """A long that sorts by score, then by earlier position."""
    return score * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - pos)


def unpacked_score(order: Column) -> Column:
    return F.shiftright(order, 40)


def unpacked_pos(order: Column) -> Column:
    return F.lit(POSITIONS - 1) - order.bitwiseAND(F.lit(POSITIONS - 1))


def flat(candidates: DataFrame, key: str = "digest") -> DataFrame:
    """Nested candidate records as the flat form. ``key`` is 'digest' or 'sample' (first rows and counts)."""
    shape = [F.col("exec.row_count").cast("string"), F.col("exec.column_count").cast("string")]
    identity = F.col("exec.digest") if key == "digest" else F.to_json("exec.sample_rows")
    succeeded = F.coalesce(F.col("exec.success"), F.lit(False))
    return candidates.select(
        "question_id", "db_id", "candidate_id", "pos", "source", "sql",
        F.coalesce(F.size("repair_history"), F.lit(0)).alias("num_repairs"),
        succeeded.alias("success"), F.col("exec.error").alias("error"), F.col("exec.row_count").alias("row_count"),
        F.col("exec.column_count").alias("column_count"), F.col("exec.is_empty").alias("is_empty"),
        F.col("exec.runtime_sec").alias("runtime_sec"),
        F.when(succeeded, F.concat_ws("|", identity, *shape)).otherwise(F.lit("failed")).alias("result_key"),
    )


def execution_groups(candidates: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """One row per (question, result): its representative, its size and its first position.

    The representative has the highest priority minus repairs, the earliest on ties. All
    failed candidates of a question share one result.
    """
    order = packed(merit(F.col("source"), F.col("num_repairs")), F.col("pos"))
    grouped = candidates.groupBy("question_id", "result_key").agg(
        F.max_by("candidate_id", order).alias("candidate_id"),
        F.max(order).alias("_order"),
        F.count(F.lit(1)).alias("group_size"),
        F.min("pos").alias("first_pos"),
        F.bool_or("success").alias("success"),
        F.bool_and(F.coalesce("is_empty", F.lit(False))).alias("is_empty"),
        *extra,
    )
    return grouped.withColumns({"merit": unpacked_score(F.col("_order")), "pos": unpacked_pos(F.col("_order"))}).drop("_order")


def majority_vote(groups: DataFrame) -> DataFrame:
    """(question_id, candidate_id, votes): the representative of the largest group, the earliest on ties."""
    order = F.struct("group_size", -F.col("first_pos"))
    return groups.groupBy("question_id").agg(
        F.max_by("candidate_id", order).alias("candidate_id"), F.max("group_size").alias("votes")
    )


def grouping_select(groups: DataFrame) -> DataFrame:
    """(question_id, candidate_id): the best representative of any group."""
    order = packed(F.col("merit"), F.col("first_pos"))
    return groups.groupBy("question_id").agg(F.max_by("candidate_id", order).alias("candidate_id"))


def rule_level(success: Column, is_empty: Column, worth: Column) -> Column:
    """An integer that sorts by success, then by non-empty result, then by merit."""
    filled = success & ~F.coalesce(is_empty, F.lit(False))
    return success.cast("long") * 10000 + filled.cast("long") * 1000 + worth


def rule_select(candidates: DataFrame) -> DataFrame:
    """(question_id, candidate_id): success first, then a non-empty result, then merit, then position."""
    level = rule_level(F.col("success"), F.col("is_empty"), merit(F.col("source"), F.col("num_repairs")))
    order = packed(level + 1000, F.col("pos"))
    return candidates.groupBy("question_id").agg(F.max_by("candidate_id", order).alias("candidate_id"))


def level_tournament(groups: DataFrame, level: Column | None = None) -> DataFrame:
    """Add ``score``, ``rank``, ``comparisons`` for a round robin whose judge compares a level.

    Whoever has the higher level wins with full confidence, equal levels tie. A round robin
    under such a judge needs no pairs: a score is fixed by how many rivals stand below and
    how many beside, and both come from the count of rivals per level.
    """
    level = level if level is not None else rule_level(F.col("success"), F.col("is_empty"), F.col("merit"))
    rivals = groups.withColumn("level", level)
    below = Window.partitionBy("question_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy("question_id")
    standing = (
        rivals.groupBy("question_id", "level")
        .agg(F.count(F.lit(1)).alias("same"))
        .withColumns(
            {"below": F.coalesce(F.sum("same").over(below), F.lit(0)), "rivals": F.sum("same").over(everyone)}
        )
    )
    win, tie = F.lit(WIN_CONFIDENCE).cast(SCORE), F.lit(TIE_CONFIDENCE / 2).cast(SCORE)
    scored = rivals.join(standing, ["question_id", "level"]).withColumns(
        {
            "score": (win * F.col("below") + tie * (F.col("same") - 1)).cast(SCORE),
            "comparisons": F.col("rivals") - 1,
        }
    )
    along = [Along(F.col("level"), descending=True), Along(F.floor(F.col("first_pos") / POSITIONS_PER_CHUNK))]
    return numbered(scored, ["question_id"], along, [F.col("first_pos")], "rank", start=1).drop("same", "below", "rivals")


def judge_schedule(representatives: DataFrame) -> DataFrame:
    """(question_id, round, a_candidate_id, b_candidate_id): a round robin of each question's representatives, a before b.

    Made by arithmetic on their numbers (the circle method): with m the least odd number that is no smaller than the count
    less one, numbers i < j meet in round (i + j) mod m, and the last of an even count meets i in round 2i mod m. Nobody
    plays twice in a round. Takes representatives of distinct results, never raw candidates; rows hold ids alone, and the
    partners are fetched by an equi-join on (question, number).
    """
    along = [Along(F.floor(F.col("first_pos") / POSITIONS_PER_CHUNK))]
    lined = numbered(representatives.select("question_id", "candidate_id", "first_pos"), ["question_id"], along, [F.col("first_pos")], "_at")
    lined = lined.join(representatives.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n")), "question_id")
    cycle = F.col("_n") - 1 + F.col("_n") % 2
    first = F.col("_partner")
    number = F.when((F.col("_at") == F.col("_n") - 1) & (F.col("_n") % 2 == 0), 2 * first % cycle).otherwise((first + F.col("_at")) % cycle)
    later = lined.filter(F.col("_at") > 0).withColumn("_partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_at").cast("long") - 1))).select(
        "question_id", "_partner", number.cast("long").alias("round"), F.col("candidate_id").alias("b_candidate_id")
    )
    earlier = lined.select("question_id", F.col("_at").cast("long").alias("_partner"), F.col("candidate_id").alias("a_candidate_id"))
    return later.join(earlier, ["question_id", "_partner"]).select("question_id", "round", "a_candidate_id", "b_candidate_id")


def with_payload(pairs: DataFrame, candidates: DataFrame, payload: list[str]) -> DataFrame:
    """Pairs of ids with what a judge reads, as a_* and b_*: fetched by key, where the judge is asked."""
    for side in ("a", "b"):
        rows = candidates.select("question_id", F.col("candidate_id").alias(f"{side}_candidate_id"), *[F.col(c).alias(f"{side}_{c}") for c in payload if c != "candidate_id"])
        pairs = pairs.join(rows, ["question_id", f"{side}_candidate_id"])
    return pairs


def comparison_log(judged: DataFrame) -> DataFrame:
    """What is kept of judged pairs: (question_id, round, a_candidate_id, b_candidate_id, winner, confidence)."""
    return judged.select("question_id", "round", "a_candidate_id", "b_candidate_id", "winner", F.col("confidence").cast("double").alias("confidence"))


def judged_tournament(representatives: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Scores from judged pairs (question_id, a_candidate_id, b_candidate_id, winner, confidence).

    A candidate without comparisons scores 0. Sums are decimal, so their order cannot change ranks.
    """
    sure = F.col("confidence").cast(SCORE)
    half = (sure / 2).cast(SCORE)
    nothing = F.lit(0).cast(SCORE)
    shares = F.array(
        F.struct(F.col("a_candidate_id").alias("candidate_id"), F.when(F.col("winner") == "A", sure).when(F.col("winner") == "B", nothing).otherwise(half).alias("won")),
        F.struct(F.col("b_candidate_id").alias("candidate_id"), F.when(F.col("winner") == "B", sure).when(F.col("winner") == "A", nothing).otherwise(half).alias("won")),
    )
    sums = comparisons.select("question_id", F.inline(shares)).groupBy("question_id", "candidate_id").agg(
        F.sum("won").cast(SCORE).alias("score"), F.count(F.lit(1)).alias("comparisons")
    )
    scored = representatives.join(sums, ["question_id", "candidate_id"], "left").withColumns(
        {"score": F.coalesce("score", nothing), "comparisons": F.coalesce("comparisons", F.lit(0))}
    )
    along = [Along(F.col("score"), descending=True), Along(F.floor(F.col("first_pos") / POSITIONS_PER_CHUNK))]
    return numbered(scored, ["question_id"], along, [F.col("first_pos")], "rank", start=1)


def final_selection(candidates: DataFrame, groups: DataFrame, ranked: DataFrame) -> DataFrame:
    """One record per question: the winner, its SQL, the runners-up's margin and the counts.

    ``ranked`` keeps the full ranking in long form; the record carries the first three, and in ``num_comparisons`` how many
    rows of the comparison log are its question's. See :func:`select_ranked`.
    """
    podium = ranked.filter(F.col("rank") <= 3).groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias("best_candidate_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score"))),
            lambda e: F.struct(e["candidate_id"].alias("id"), e["score"].alias("score")),
        ).alias("ranked"),
        F.bool_and(F.coalesce("is_empty", F.lit(False))).alias("all_top_empty"),
    )
    judged = ranked.groupBy("question_id").agg((F.sum("comparisons") / 2).cast("long").alias("num_comparisons"))
    podium = podium.join(judged, "question_id")
    counts = groups.groupBy("question_id").agg(
        F.sum("group_size").alias("num_original_candidates"), F.count(F.lit(1)).alias("num_representatives")
    )
    record = podium.join(counts, "question_id")
    if "sql" in candidates.columns:
        texts = candidates.select("question_id", F.col("candidate_id").alias("best_candidate_id"), clean_sql(F.col("sql")).alias("final_sql"))
        record = record.join(texts, ["question_id", "best_candidate_id"], "left")
    return record


def select_ranked(candidates: DataFrame, level: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The record of :func:`final_selection`, and the whole ranking: (question_id, rank, candidate_id, score).

    Groups by result, ranks by the level judge, keeps the winner. The groups are far fewer than the candidates and are
    read by several steps: they are materialized, so that the candidates are scanned once.
    """
    groups = stable(execution_groups(candidates))
    ranked = level_tournament(groups, level)
    return final_selection(candidates, groups, ranked), ranked.select("question_id", "rank", "candidate_id", "score")


def select_final(candidates: DataFrame, level: Column | None = None) -> DataFrame:
    """The record alone, of :func:`select_ranked`."""
    return select_ranked(candidates, level)[0]
