"""Wrong variants of correct queries, as pattern replacements on the query text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesage.functions.binding import let
from tablesage.functions.text import strip_space

# The kinds of mutation, the patterns they replace and the texts they leave.
# (?d) lets "." and "$" treat only the newline as line end, (?U) makes \w and \b Unicode-aware.
DISTINCT = r"(?iU)\bdistinct\b"
COUNT_DISTINCT = r"(?id)count\s*\(\s*distinct[^)]+\)"
DESCENDING = r"(?iU)\bdesc\b"
ASCENDING = r"(?iU)\basc\b"
GROUP_CLAUSE = r"(?id)\bgroup\s+by\s+.*?(?=\border\s+by\b|\blimit\b|$)"
WHERE_CLAUSE = r"(?id)\bwhere\s+.*?(?=\bgroup\s+by\b|\border\s+by\b|\blimit\b|$)"
LITERAL = r"(?U)'\w+'|\b\d+\b"
JOIN_KEYS = r"(?iU)(\bON\b\s+\w+\.)(\w+)(\s*=\s*\w+\.)(\w+)"
CAST_CALL = r"(?id)cast\s*\((.*?)\s+as\s+\w+\)"
QUALIFIED_NAME = r"(?U)\b\w+\.\w+\b"
WORD = r"(?U)\b\w+\b"
SWAPPED_AGGREGATES = {"SUM": "AVG", "AVG": "SUM", "MIN": "MAX", "MAX": "MIN"}


def _has(sql: Column, word: str) -> Column:
    return F.lower(sql).contains(word)


def _pick(options: Column, sql: Column, seed: int) -> Column:
    """One of the options, chosen by the query text: the same text always gives the same choice."""
    number = F.conv(F.substring(F.md5(F.concat(sql, F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long")
    return let(options, lambda o: F.when(F.size(o) > 0, F.try_element_at(o, (F.pmod(number, F.size(o)) + 1).cast("int"))))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _replaced(sql: Column, old: Column, new: Callable[[Column], Column]) -> Column:
    return let(old, lambda o: F.when(o.isNotNull() & (o != ""), F.replace(sql, o, new(o))))


def _bumped(literal: Column) -> Column:
    number = (literal.try_cast("decimal(38,0)") + 1).cast("string")
    return F.when(literal.rlike(r"^\d+$"), number).otherwise(
        F.concat(F.lit("'"), F.btrim(literal, F.lit("'")), F.lit("__mutated'"))
    )


def _swap_aggregates(sql: Column) -> Column:
    """SUM and AVG, MIN and MAX trade places; a mark keeps a swapped name from being swapped back."""
    out = sql
    for name, other in SWAPPED_AGGREGATES.items():
        out = F.regexp_replace(out, rf"(?i)(?<!\u0001)\b{name}(\s*\()", f"\u0001{other}$1")
    return F.regexp_replace(out, "\u0001", "")


def _mutated(sql: Column, seed: int) -> dict[str, Column]:
    """Kind of mutation to the mutated text, NULL where the kind does not apply."""
    after_where = F.coalesce(F.try_element_at(F.split(F.lower(sql), "where"), F.lit(2)), F.lit(""))
    return {
        "remove_distinct": F.when(_has(sql, "distinct"), F.regexp_replace(sql, DISTINCT, "")),
        "count_star_vs_count_distinct": F.when(
            F.replace(F.lower(sql), F.lit(" ")).contains("count(distinct"), F.regexp_replace(sql, COUNT_DISTINCT, "COUNT(*)")
        ),
        "wrong_order_direction": F.when(_has(sql, "desc"), F.regexp_replace(sql, DESCENDING, "ASC")).when(
            _has(sql, "asc"), F.regexp_replace(sql, ASCENDING, "DESC")
        ),
        "remove_group_by": F.when(_has(sql, "group by"), F.regexp_replace(sql, GROUP_CLAUSE, "")),
        "remove_where_condition": F.when(_has(sql, "where"), F.regexp_replace(sql, WHERE_CLAUSE, "")),
        "replace_aggregation": _swap_aggregates(sql),
        "replace_literal": _replaced(sql, _pick(_all(sql, LITERAL), sql, seed), _bumped),
        "wrong_join_column": F.when(
            _has(sql, " join ") & _has(sql, " on "), F.regexp_replace(sql, JOIN_KEYS, "$1$2_id$3$4")
        ),
        "remove_cast_or_add_wrong_cast": F.when(_has(sql, "cast("), F.regexp_replace(sql, CAST_CALL, "$1")).otherwise(
            _replaced(sql, _pick(_all(sql, QUALIFIED_NAME), sql, seed + 1), lambda c: F.concat(F.lit("CAST("), c, F.lit(" AS TEXT)")))
        ),
        "replace_filter_column": F.when(
            _has(sql, "where"), _replaced(sql, _pick(_all(after_where, WORD), sql, seed + 2), lambda w: F.concat(w, F.lit("_mut")))
        ),
    }


def _tidy(sql: Column) -> Column:
    return F.replace(strip_space(sql), F.lit("  "), F.lit(" "))


def mutations(sql: Column, seed: int = 0) -> Column:
    """array<struct<ordinal, kind, mutated_sql>>: the mutations that change the text."""
    made = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("kind"), _tidy(text).alias("mutated_sql"))
            for i, (kind, text) in enumerate(_mutated(sql, seed).items())
        ]
    )
    return let(_tidy(sql), lambda plain: F.filter(made, lambda m: m["mutated_sql"].isNotNull() & (m["mutated_sql"] != plain)))


def mutate_queries(queries: DataFrame, sql: str = "sql", seed: int = 0) -> DataFrame:
    """(all columns of ``queries``, ordinal, kind, mutated_sql): one row per mutation that changes the text."""
    return queries.select("*", F.inline(mutations(F.col(sql), seed)))


def candidate_pool(samples: DataFrame, seed: int = 0) -> DataFrame:
    """(question_id, db_id, candidate_id, pos, source, sql): the correct query, its mutations and two simple variants.

    ``samples`` has (question_id, db_id, SQL).
    """
    source = F.col("SQL")

    def entry(tail: Column, name: Column, sql: Column) -> Column:
        return F.struct(tail.alias("tail"), name.alias("source"), sql.alias("sql"))

    variants = F.array(
        entry(F.lit("gen_reasoning_0"), F.lit("reasoning_generator"), F.replace(source, F.lit("SELECT"), F.lit("select"))),
        F.when(
            _has(source, "join"),
            entry(F.lit("gen_join_0"), F.lit("join_focused_generator"), F.substring_index(source, "JOIN", 1)),
        ),
    )
    wrong = F.transform(
        mutations(source, seed),
        lambda m: entry(F.concat(F.lit("mut_"), m["kind"]), F.concat(F.lit("mutation_"), m["kind"]), m["mutated_sql"]),
    )
    pool = F.concat(F.array(entry(F.lit("gold"), F.lit("gold"), source)), wrong, F.filter(variants, lambda e: e.isNotNull()))
    return samples.select("question_id", "db_id", F.posexplode(pool).alias("pos", "entry")).select(
        "question_id", "db_id", F.concat_ws("_", "question_id", "entry.tail").alias("candidate_id"),
        "pos", "entry.source", "entry.sql",
    )
