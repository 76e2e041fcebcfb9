"""Training rows from executed candidates: scores, labels, pairs, rewards, chat rows, splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.functions.similarity import best_ratio, best_ratios_of_columns
from tablesage.functions.text import split_words
from tablesage.operators.catalog_join import join_catalog
from tablesage.operators.numbering import Along, listed, numbered
from tablesage.operators.ordering import positions
from tablesage.operators.selection import POSITIONS_PER_CHUNK, SOURCE_PRIORITY
from tablesage.session import few, ship_package, stable

# Scores, rewards, labels and formats of the training rows.
SLOWEST_USEFUL_SEC = 10.0
EXECUTABLE_REWARD = 0.2
PAIRS_PER_QUESTION = 20
PARTNERS_PER_CLASS = 2
ASKERS_PER_KEY = 1024
CONTEXT_COLUMNS, CONTEXT_JOINS, CONTEXT_RULES = 30, 10, 10
SFT_SYSTEM = "You are a Text-to-SQL model. Generate valid SQLite SQL only."
NO_EVIDENCE = "No evidence provided."
MATCH, SAME_SHAPE, WRONG = 2, 1, 0
#: Columns of a database that a question is compared with at once; beyond, each pair is a row from the start.
COLUMNS_AT_ONCE = 256


def quality_score(is_correct: Column, success: Column, row_count: Column, runtime_sec: Column) -> Column:
    """2 plus a speed bonus when correct, 1.5 when it returns rows, 1 when it runs, else 0."""
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - runtime_sec / SLOWEST_USEFUL_SEC))
    return (
        F.when(is_correct, 2 + bonus)
        .when(success & (F.coalesce(row_count, F.lit(0)) > 0), F.lit(1.5))
        .when(success, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def with_quality_score(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn(
        "score", quality_score(F.col("is_correct"), F.col("success"), F.col("row_count"), F.col("runtime_sec"))
    )


def reward(is_correct: Column, success: Column) -> Column:
    return F.when(is_correct, F.lit(1.0)).when(~F.coalesce(success, F.lit(False)), F.lit(0.0)).otherwise(F.lit(EXECUTABLE_REWARD))


def rollout_rewards(candidates: DataFrame) -> DataFrame:
    """(question_id, db_id, candidate_id, reward)."""
    return candidates.select("question_id", "db_id", "candidate_id", reward(F.col("is_correct"), F.col("success")).alias("reward"))


def rollout_pool(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, part, db_id, prompt, candidates, reward_map); see :func:`listed` for ``part``."""
    item = F.struct(
        F.col("candidate_id").cast("string").alias("candidate_id"), "source", reward(F.col("is_correct"), F.col("success")).alias("reward")
    )
    lists = listed(candidates, ["question_id"], F.col("pos"), item, "candidates")
    prompt = F.concat(
        F.lit("Question: "), "question", F.lit("\nEvidence: "),
        F.when(F.coalesce("evidence", F.lit("")) == "", F.lit("None")).otherwise(F.col("evidence")),
        F.lit("\nAnswer with the id of the best candidate."),
    )
    rewards = F.map_from_entries(F.transform("candidates", lambda c: F.struct(c["candidate_id"], c["reward"])))
    return lists.join(questions, "question_id").select("question_id", "part", "db_id", prompt.alias("prompt"), "candidates", rewards.alias("reward_map"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """(question_id, best_candidate_id, num_candidates): the fastest correct candidate, NULL where none is correct."""
    order = F.struct("runtime_sec", "pos")
    return candidates.groupBy("question_id").agg(
        F.min_by("candidate_id", F.when(F.col("is_correct"), order)).alias("best_candidate_id"),
        F.count(F.lit(1)).alias("num_candidates"),
    )


def listwise_rows(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """(question_id, part, candidates, best_candidate_id); see :func:`listed` for ``part``."""
    lists = listed(candidates, ["question_id"], F.col("pos"), F.struct(*fields), "candidates")
    return lists.join(best_candidates(candidates).drop("num_candidates"), "question_id")


def seeded_number(key: Column, seed: int) -> Column:
    """A number from 0 to 2**32-1 fixed by key and seed; also computable in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def sampled_pair_positions(counts: DataFrame, k: int = PAIRS_PER_QUESTION, seed: int = 0) -> DataFrame:
    """(question_id, draw, pos_a, pos_b): all pairs of a question if it has at most ``k``, else ``k`` of them.

    ``counts`` is (question_id, n) with candidates at positions 0 to n-1. Pairs are numbered
    0 to n(n-1)/2-1; one number is drawn in each of ``k`` equal stretches and turned into its
    two positions by arithmetic. No pair that is not drawn is ever made.
    """
    pairs = F.expr("n * (n - 1) div 2")
    drawn = counts.withColumn("pairs", pairs).filter("pairs > 0").withColumn("draws", F.least(F.col("pairs"), F.lit(k)))
    rows = drawn.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("draws").cast("int") - 1)))
    low = F.expr("draw * pairs div draws")
    high = F.expr("(draw + 1) * pairs div draws")
    number = low + F.pmod(seeded_number(F.concat_ws("#", F.col("question_id").cast("string"), F.col("draw").cast("string")), seed), high - low)
    # Pair number p belongs to the later position b with b(b-1)/2 <= p < b(b+1)/2.
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("number").cast("double"))) / 2)
    exact = (
        F.when(guess * (guess - 1) / 2 > F.col("number"), guess - 1)
        .when(guess * (guess + 1) / 2 <= F.col("number"), guess + 1)
        .otherwise(guess)
    )
    placed = rows.withColumn("number", number).withColumn("pos_b", exact.cast("long"))
    return placed.select(
        "question_id", "draw", (F.col("number") - F.expr("pos_b * (pos_b - 1) div 2")).alias("pos_a"), "pos_b"
    )


def winner_of(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit("tie")).when(a > b, F.lit("A")).otherwise(F.lit("B"))


def other_side(winner: Column) -> Column:
    return F.when(winner == "A", F.lit("B")).when(winner == "B", F.lit("A")).otherwise(F.lit("tie"))


def pairwise_rows(candidates: DataFrame, payload: list[str], k: int = PAIRS_PER_QUESTION, seed: int = 0) -> DataFrame:
    """(question_id, draw, a_*, b_*, winner, chosen, rejected) for the drawn pairs.

    Positions are drawn first; the candidates at them are then fetched by (question,
    position) in one join for both sides, so no key is heavier than the draws that hit it.
    """
    scored = with_quality_score(candidates)
    counts = candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    fields = list(dict.fromkeys([*payload, "score"]))
    wanted = sampled_pair_positions(counts, k, seed).select(
        "question_id", "draw",
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("pos_a").alias("pos")),
                F.struct(F.lit("b").alias("side"), F.col("pos_b").alias("pos")),
            )
        ),
    )
    payloads = scored.select("question_id", F.col("pos").cast("long").alias("pos"), F.struct(*fields).alias("candidate"))
    fetched = wanted.join(payloads, ["question_id", "pos"])
    sides = fetched.groupBy("question_id", "draw").agg(
        *[F.first(F.when(F.col("side") == s, F.col("candidate")), ignorenulls=True).alias(s) for s in ("a", "b")]
    )
    winner = winner_of(F.col("a_score"), F.col("b_score"))
    return sides.select(
        "question_id", "draw", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in fields]
    ).withColumns({"winner": winner, "chosen": winner, "rejected": other_side(winner)})


def pair_prompt(question: Column, evidence: Column, sides: dict[str, dict[str, Column]]) -> Column:
    """Training text of a pair; ``sides`` maps A and B to sql, success, row_count and error."""
    parts = [F.concat(F.lit("Question:\n"), question), F.concat(F.lit("Evidence:\n"), F.coalesce(evidence, F.lit("")))]
    for name, side in sides.items():
        run = F.concat(
            F.lit("success="), side["success"].cast("string"), F.lit(", rows="), F.coalesce(side["row_count"].cast("string"), F.lit("None")),
            F.lit(", error="), F.coalesce(side["error"], F.lit("None")),
        )
        parts += [F.concat(F.lit(f"SQL {name}:\n"), side["sql"]), F.concat(F.lit(f"Execution {name}:\n"), run)]
    return F.concat_ws("\n\n", *parts, F.lit("Which SQL is better? Answer A, B, or tie."))


def label_candidates(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Add ``label``: 2 same result as gold, 1 same numbers of rows and columns, else 0.

    ``gold`` is (question_id, gold_key, gold_rows, gold_columns); a question without gold is
    left out.
    """
    same_shape = (F.col("row_count") == F.col("gold_rows")) & (F.col("column_count") == F.col("gold_columns"))
    label = (
        F.when(~F.coalesce(F.col("success"), F.lit(False)), WRONG)
        .when(F.col("result_key") == F.col("gold_key"), MATCH)
        .when(same_shape, SAME_SHAPE)
        .otherwise(WRONG)
    )
    return candidates.join(gold, "question_id").withColumn("label", label).drop("gold_key", "gold_rows", "gold_columns")


def _family() -> Column:
    return F.when(F.col("source").isin(list(SOURCE_PRIORITY)), F.col("source")).otherwise(F.lit("other"))


def preference_pairs(labeled: DataFrame) -> DataFrame:
    """Labelled pairs of a question, one row per pair of candidate classes with the pairs it stands for.

    The winner of a pair depends on the labels only, so candidates of one question with the
    same label and source form a class with its earliest candidate as representative. Three
    labels and the known sources (others count as one) bound a question to
    3 * (sources + 1) classes, whatever its number of candidates. ``n_pairs`` adds up to all
    pairs of the question. The first and last candidate stand for the pairs inside a class.
    An overview of the classes; for rows with every candidate see :func:`preference_rows`.
    """
    family = _family()
    classes = labeled.groupBy("question_id", "label", family.alias("class_source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min_by("candidate_id", "pos").alias("first_id"), F.max_by("candidate_id", "pos").alias("last_id"),
    )
    entry = F.struct("first_pos", "first_id", "last_pos", "last_id", "label", "class_source", "n")
    lined = classes.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))

    def pair(a: Column, b_id: Column, b_pos: Column, b: Column, n_pairs: Column) -> Column:
        return F.struct(
            a["first_id"].alias("candidate_a"), b_id.alias("candidate_b"), a["first_pos"].alias("pos_a"), b_pos.alias("pos_b"),
            a["class_source"].alias("source_a"), b["class_source"].alias("source_b"),
            a["label"].alias("label_a"), b["label"].alias("label_b"), n_pairs.alias("n_pairs"),
        )

    across = F.flatten(
        F.transform(
            "c",
            lambda a, i: F.transform(
                F.slice("c", i + 2, F.size("c")), lambda b: pair(a, b["first_id"], b["first_pos"], b, a["n"] * b["n"])
            ),
        )
    )
    inside = F.transform(
        F.filter("c", lambda a: a["n"] > 1),
        lambda a: pair(a, a["last_id"], a["last_pos"], a, F.floor(a["n"] * (a["n"] - 1) / 2)),
    )
    rows = lined.select("question_id", F.inline(F.concat(across, inside)))
    return rows.withColumn("winner", winner_of(F.col("label_a"), F.col("label_b")))


def preference_rows(labeled: DataFrame, k: int = PARTNERS_PER_CLASS, seed: int = 0) -> DataFrame:
    """Labelled pairs of candidates in which every candidate meets every class (label, source) of its question.

    Of two classes, each candidate of the larger one gets ``k`` seeded partners in the smaller one (all, if it has
    fewer), which reaches all of the smaller one; inside a class each gets ``k`` at seeded distances. So the rows are
    linear in the candidates, no pair occurs twice, and no candidate is left out unless it is alone. ``n_pairs`` is the
    number of pairs that a row stands for; it adds up to all pairs of the question. Partners are found by their rank
    in the class; those whom many ask are repeated, so that no key has more than about ``k * ASKERS_PER_KEY`` rows.
    """
    own = ["question_id", "label", "class_source"]
    rows = stable(labeled.select("question_id", "candidate_id", F.col("pos").cast("long").alias("pos"), "label", _family().alias("class_source")))
    chunk = F.floor(F.col("pos") / POSITIONS_PER_CHUNK)
    placed = numbered(rows, own, [Along(chunk)], [F.col("pos")], "_rank").withColumn("_chunk", chunk)
    # What a class asks of the others is made once per class and not once per candidate; a hot class is joined by its chunks.
    counted = rows.groupBy(*own, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("n"))
    sized = counted.groupBy(*own).agg(F.sum("n").alias("n"), F.collect_list("_chunk").alias("chunks"))
    lined = sized.groupBy("question_id").agg(F.sum("n").alias("_all"), F.array_sort(F.collect_list(F.struct("class_source", "label", "n", "chunks"))).alias("_lined"))
    numbers = lambda c, i: F.struct(*[c[f].alias(f) for f in ("n", "label", "class_source")], i.alias("no"))
    classes = lined.withColumn("_classes", F.transform("_lined", numbers)).select("question_id", "_all", "_classes", F.posexplode("_lined").alias("_no", "_own"))
    copies = lambda size: F.floor(F.col("_all") / (size * ASKERS_PER_KEY)) + 1
    each = stable(classes.select(
        "question_id", "_no", "_own.label", "_own.class_source", F.explode("_own.chunks").alias("_chunk"), copies(F.col("_own.n")).alias("_copies"),
        _asks(copies, k, seed).alias("_asks"),
    ))
    met = stable(placed.join(each.drop("_asks"), [*own, "_chunk"]))

    drawn = met.join(each.select("question_id", "_no", "_chunk", "_asks"), ["question_id", "_no", "_chunk"]).select(
        "question_id", "_no", "candidate_id", "pos", "label", "class_source", "_rank", F.inline("_asks")
    ).where(F.col("_rank") < F.col("below"))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("pos", "candidate_id", "label", "class_source")]
    wanted = drawn.select(
        "question_id", F.col("to").alias("y_no"), F.pmod(F.col("_rank") + F.col("step"), F.col("m")).alias("_rank"),
        F.when(F.col("copies") > 1, F.pmod(F.xxhash64("candidate_id", "to", "step"), F.col("copies"))).otherwise(F.lit(0).cast("long")).alias("_copy"),
        F.col("_no").alias("x_no"), *side("x"), "n_pairs",
    )
    members = met.select("question_id", F.col("_no").alias("y_no"), "_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"), *side("y"))
    # Classes are numbered by source and label, so this is the order of (pos, candidate_id, class_source, label).
    place = lambda s: F.struct(F.col(f"{s}_pos").alias("pos"), F.col(f"{s}_candidate_id").alias("id"), F.col(f"{s}_no").alias("no"))
    pairs = wanted.join(members, ["question_id", "y_no", "_rank", "_copy"]).withColumn("_first", place("x") <= place("y"))
    a, b = ((lambda c, f=f, g=g: F.when(F.col("_first"), F.col(f"{f}_{c}")).otherwise(F.col(f"{g}_{c}"))) for f, g in ("xy", "yx"))
    return pairs.select(
        "question_id", *[x(c).alias(f"{name}_{s}") for c, name in (("candidate_id", "candidate"), ("pos", "pos"), ("class_source", "source"), ("label", "label")) for s, x in (("a", a), ("b", b))],
        "n_pairs", winner_of(a("label"), b("label")).alias("winner"),
    )


def _asks(copies: Callable[[Column], Column], k: int, seed: int) -> Column:
    """The draws of a class ``_own``, number ``_no`` of ``_classes``: (to, m, copies, step, below, n_pairs), ``to`` being the other class's number.

    Partners are told apart by a step from the own rank: 0 to m-1 across, 1 to (n-1)/2 inside, where the step n/2 is one
    for both sides and drawn by the ranks below it only.
    """
    div = lambda a, b: F.call_function("div", a, b)
    n, no = F.col("_own.n"), F.col("_no")
    key = F.concat_ws("#", "question_id", F.col("_own.label"), F.col("_own.class_source"))

    def of_class(to: Column) -> Column:
        inside, m = to["no"] == no, to["n"]
        steps = F.when(inside, div(n - 1, F.lit(2))).otherwise(m)
        most = F.least(steps, F.lit(k).cast("long"))
        half = inside & (n % 2 == 0) & (steps < k)
        draws = most + half.cast("long")
        weight = F.when(inside, n * (n - 1) / 2 / (n * most + F.when(half, div(n, F.lit(2))).otherwise(F.lit(0)))).otherwise(m / most)
        wide = F.greatest(most, F.lit(1).cast("long"))

        def draw(j: Column) -> Column:
            low, high = div(j * steps, wide), div((j + 1) * steps, wide)
            number = seeded_number(F.concat_ws("#", key, to["label"], to["class_source"], j), seed)
            step = F.when(j == most, div(n, F.lit(2))).otherwise(inside.cast("long") + low + F.pmod(number, F.greatest(high - low, F.lit(1).cast("long"))))
            below = F.when(j == most, div(n, F.lit(2))).otherwise(n)
            fields = {"to": to["no"], "m": m, "copies": copies(m), "step": step, "below": below, "n_pairs": weight}
            return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])

        return F.when(draws > 0, F.transform(F.sequence(F.lit(0).cast("long"), draws - 1), draw)).otherwise(F.array())

    mine = F.struct(n.alias("n"), F.col("_own.label").alias("label"), F.col("_own.class_source").alias("class_source"), no.alias("no"))
    return F.flatten(F.transform(F.filter("_classes", lambda c: c <= mine), of_class))


def with_context(pairs: DataFrame, contexts: DataFrame, form: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Pairs with the question and a compact context: at most 30 columns, 10 joins and 10 rules.

    ``form`` is what becomes of each list, made once per question and not once per pair.
    """
    lists = {
        "top_columns": F.slice("columns", 1, CONTEXT_COLUMNS), "matched": F.col("matched"), "constraints": F.col("constraints"),
        "top_joins": F.slice("joins", 1, CONTEXT_JOINS), "business_rules": F.slice("rules", 1, CONTEXT_RULES),
    }
    compact = contexts.select("question_id", "db_id", "question", "evidence", F.struct(*[form(x).alias(c) for c, x in lists.items()]).alias("context"))
    return pairs.join(compact, "question_id")


def chat_sft_rows(samples: DataFrame, schema_texts: DataFrame) -> DataFrame:
    """(question_id, db_id, messages): system, user and assistant turns; questions without a profiled database are left out.

    ``samples`` is (question_id, db_id, question, evidence, SQL), ``schema_texts`` (db_id, ddl).
    """
    evidence = F.when(F.coalesce("evidence", F.lit("")) == "", F.lit(NO_EVIDENCE)).otherwise(F.col("evidence"))
    user = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nEvidence:\n"), evidence, F.lit("\n\nSchema:\n"), "ddl")

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(turn("system", F.lit(SFT_SYSTEM)), turn("user", user), turn("assistant", F.col("SQL")))
    joined = join_catalog(samples, schema_texts.select("db_id", "ddl"), ["db_id"], ["question_id"])
    return joined.select("question_id", "db_id", messages.alias("messages"))


def chat_rows(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(conv_id, part, messages): the turns of a conversation in order; see :func:`listed` for ``part``."""
    return listed(turns, [by], F.col("turn"), F.struct("role", F.col("text").alias("content")), "messages")


def ranker_rows(roles: DataFrame, questions: DataFrame, profiles: DataFrame, fuzzy: bool = True) -> DataFrame:
    """A labelled row for every (question, column of its database).

    Label 2: the query uses the column, 1: it uses the table, 0: neither. ``roles`` comes
    from ``clause_roles``. ``fuzzy`` adds the two similarity features, which need Python.
    """
    asked = questions.join(roles.filter(~F.col("parse_error")).select("question_id", "tables_used", "columns_used", "literals_used"), "question_id")
    asked = asked.select(
        "question_id", "db_id", F.array_distinct(split_words(F.lower("question"))).alias("q_words"), "tables_used", "columns_used",
        F.transform("literals_used", lambda v: F.lower(v)).alias("literals"),
    )
    # What a column says by itself is made once per column and not once per pair.
    parts = F.array_distinct(F.split(F.lower("column_name"), "_"))
    columns = stable(profiles.select(
        "db_id", "table_name", "column_name", F.concat_ws(".", "table_name", "column_name").alias("candidate"), parts.alias("parts"), F.lower("column_name").alias("lowered"),
        F.upper("data_type").rlike("TEXT|STRING").cast("int").alias("profile_type_match"), F.transform("top_values.value", lambda v: F.lower(v)).alias("values"),
    ))
    size = F.length(F.to_json(F.struct("*")))
    if few(columns, size):
        catalog = columns.collect()
        if _listed(catalog):
            return _ranked_by_question(asked, catalog, columns.schema, fuzzy)
        met = asked.join(F.broadcast(columns), "db_id")
    else:
        met = join_catalog(asked, columns, ["db_id"], ["question_id"])
    label = (
        F.when(F.array_contains("columns_used", F.col("candidate")), 2).when(F.array_contains("tables_used", F.col("table_name")), 1).otherwise(0)
    )
    rows = met.select(
        *_pair(F.round(F.size(F.array_intersect("q_words", "parts")) / F.size("parts"), 4), F.coalesce(F.arrays_overlap("literals", "values").cast("int"), F.lit(0)), label),
        "q_words", "literals", "values", "lowered",
    )
    plain = rows.drop("q_words", "literals", "values", "lowered")
    if not fuzzy:
        return plain
    return rows.withColumns(
        {
            "semantic_sim_question_column": F.round(best_ratio("q_words", F.array("lowered")), 4),
            "literal_fuzzy_match": F.round(best_ratio("literals", "values"), 4),
        }
    ).drop("q_words", "literals", "values", "lowered")


def _pair(name_overlap: Column, literal_exact_match: Column, label: Column) -> list[Column]:
    return [
        *[F.col(c) for c in ("question_id", "db_id", "table_name", "column_name", "candidate")], name_overlap.alias("name_overlap"),
        literal_exact_match.alias("literal_exact_match"), F.col("profile_type_match"), F.lit(0.0).alias("query_log_support"), label.alias("label"),
    ]


def _listed(catalog: list[Row]) -> bool:
    """Whether the columns can be told apart by number: no database has too many, and none lacks a name or a value."""
    counts: dict[str, int] = {}
    for c in catalog:
        counts[c.db_id] = counts.get(c.db_id, 0) + 1
        if None in (c.db_id, c.table_name, c.column_name, c["values"]) or None in c["values"]:
            return False
    return max(counts.values(), default=0) <= COLUMNS_AT_ONCE


def _ranked_by_question(asked: DataFrame, catalog: list[Row], schema: T.StructType, fuzzy: bool) -> DataFrame:
    """What a question says of each column of its database comes as lists, by the columns' numbers; pairs only pick their entries."""
    spark = asked.sparkSession
    ship_package(spark)
    databases: dict[str, list[Row]] = {}
    for c in catalog:
        databases.setdefault(c.db_id, []).append(c)
    numbered_columns = [(*c, no, list(range(len(c.parts) + 1))) for cs in databases.values() for no, c in enumerate(cs)]
    numbered_schema = T.StructType([*schema.fields, T.StructField("no", T.IntegerType()), T.StructField("shares", T.ArrayType(T.IntegerType()))])
    # The shares that a number of words in common can be are rounded once per column.
    shares = F.transform("shares", lambda n: F.round(n / F.size("parts"), 4))
    columns = spark.createDataFrame(numbered_columns, numbered_schema).withColumn("shares", shares).drop("values", "parts", "lowered")
    found = column_lists({db: [(c.table_name, c.lowered, c.candidate, c.parts, c["values"]) for c in cs] for db, cs in databases.items()}, fuzzy)
    lists = asked.select("question_id", "db_id", found("db_id", "q_words", "tables_used", "columns_used", "literals").alias("_of"))
    of = lambda name: F.get(F.col(f"_of.{name}"), F.col("no"))
    met = lists.join(F.broadcast(columns), "db_id")
    rows = _pair(F.get("shares", of("shared")), of("exact"), of("label"))
    return met.select(*rows, *([of(n).alias(n) for n in ("semantic_sim_question_column", "literal_fuzzy_match")] if fuzzy else []))


def column_lists(databases: dict[str, list[tuple[str, str, str, list[str], list[str]]]], fuzzy: bool) -> Callable[..., Column]:
    """A function of (db_id, q_words, tables_used, columns_used, literals) that gives an entry for each column of the question's database."""
    names = ["shared", "exact", "label", *(["semantic_sim_question_column", "literal_fuzzy_match"] if fuzzy else [])]
    kinds = [T.IntegerType()] * 3 + [T.DoubleType()] * 2

    def of_database(columns, q_words: pa.Array, tables: pa.Array, used: pa.Array, literals: pa.Array) -> list[np.ndarray]:
        shared = _met(q_words, [c[3] for c in columns])
        exact = _met(literals, [c[4] for c in columns]) > 0
        label = np.where(_met(used, [[c[2]] for c in columns]) > 0, MATCH, _met(tables, [[c[0]] for c in columns]) > 0)
        return [shared, exact, label] if not fuzzy else [
            shared, exact, label, best_ratios_of_columns(q_words, [[c[1]] for c in columns], 4), best_ratios_of_columns(literals, [c[4] for c in columns], 4),
        ]

    @F.arrow_udf(T.StructType([T.StructField(n, T.ArrayType(k)) for n, k in zip(names, kinds)]))
    def lists(db_id: pa.Array, q_words: pa.Array, tables: pa.Array, used: pa.Array, literals: pa.Array) -> pa.Array:
        types = [pa.int32()] * 3 + [pa.float64()] * 2
        order, parts, left = [], [[] for _ in names], np.ones(len(db_id), bool)
        for db, columns in databases.items():
            rows = np.flatnonzero(pc.fill_null(pc.equal(db_id, db), False).to_numpy(zero_copy_only=False))
            if len(rows):
                left[rows] = False
                order.append(rows)
                given = [x if len(rows) == len(db_id) else x.take(pa.array(rows)) for x in (q_words, tables, used, literals)]
                for part, matrix, kind in zip(parts, of_database(columns, *given), types):
                    empty = given[0].is_null().to_numpy(zero_copy_only=False) if part is parts[0] else np.zeros(len(rows), bool)
                    part.append(_list_array(matrix, kind, empty))
        rest = np.flatnonzero(left)
        order.append(rest)
        for part, kind in zip(parts, types):
            part.append(pa.nulls(len(rest), pa.list_(kind)))
        back = pa.array(np.argsort(np.concatenate(order), kind="stable"))
        lists_ = [pa.concat_arrays(part) if len(part) == 1 or not len(rest) and len(part) == 2 else pa.concat_arrays(part).take(back) for part in parts]
        return pa.StructArray.from_arrays(lists_, names)

    return lists


def _met(lists: pa.Array, columns: list[list[str]]) -> np.ndarray:
    """How many entries of each list are among the texts of each column."""
    places: dict[str, list[int]] = {}
    for no, texts in enumerate(columns):
        for text in dict.fromkeys(texts):
            places.setdefault(text, []).append(no)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(list(places), lists.type.value_type)), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(at >= 0)
    owner, at = np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]
    lengths = np.fromiter(map(len, places.values()), np.int64, len(places))
    numbers = np.fromiter((no for nos in places.values() for no in nos), np.int64, int(lengths.sum()))
    many = lengths[at]
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    column = numbers[np.repeat((np.cumsum(lengths) - lengths)[at], many) + within]
    return np.bincount(np.repeat(owner, many) * len(columns) + column, minlength=len(sizes) * len(columns)).reshape(len(sizes), len(columns))


def _list_array(matrix: np.ndarray, kind: pa.DataType, empty: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists; those that are empty are NULL."""
    ends = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel().astype(kind.to_pandas_dtype())), mask=pa.array(empty) if empty.any() else None)


def hash_split(rows: DataFrame, key: str = "question_id", dev_share: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``split`` by question, so that no question is on both sides."""
    dev = F.pmod(seeded_number(F.col(key), seed), F.lit(1000)) < int(dev_share * 1000)
    return rows.withColumn("split", F.when(dev, F.lit("dev")).otherwise(F.lit("train")))


def positional_split(rows: DataFrame, order: list[Along], train_share: float = 0.9) -> DataFrame:
    """Add ``split``: the first share of the rows in ``order`` trains, the rest is held out."""
    placed = positions(rows, [], order, "_at", total="_total")
    first = F.col("_at") < F.floor(F.col("_total") * F.lit(train_share))
    return placed.withColumn("split", F.when(first, F.lit("train")).otherwise(F.lit("dev"))).drop("_at", "_total")
