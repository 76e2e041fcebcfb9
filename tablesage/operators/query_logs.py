"""Mining of query logs. Logs repeat texts heavily, so statistics work on distinct texts with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesage.functions import sqltext
from tablesage.functions.binding import let
from tablesage.functions.text import clean_sql
from tablesage.operators.numbering import top_per_group
from tablesage.operators.value_links import contained_in
from tablesage.session import stable, wide_parts


def log_features(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add tables, columns, joins, where, group_by and parse_error to every log row."""
    def fields(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        found = {
            "tables": sqltext.table_names(bare),
            "columns": sqltext.column_names(bare),
            "joins": sqltext.join_predicates(text),
            "where": F.concat(F.lit("WHERE "), sqltext.clause(text, "where")),
            "group_by": F.concat(F.lit("GROUP BY "), sqltext.clause(text, r"group\s+by")),
        }
        return {n: F.when(good, c) for n, c in found.items()} | {"parse_error": ~good}

    return sqltext.with_features(log, sql, fields)


def clause_roles(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add which columns, join predicates, aggregates and literals each clause of the query uses.

    Names are qualified by table where an alias says which one, as in ``orders.o_custkey``.
    Rows that fail the lexical check get NULLs and ``parse_error`` true, to be routed aside.
    """
    def shared(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        return {"_refs": sqltext.table_refs(bare), "_aliased": sqltext.table_aliases(bare)}

    def owners(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        refs, aliased = F.col("_refs"), F.col("_aliased")
        return {"_aliases": sqltext.alias_map(refs, aliased), "_given": sqltext.given_names(bare, refs, aliased)}

    def fields(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        def qualified(piece: Column) -> Column:
            def named(aliases: Column, given: Column) -> Column:
                def name(ref: Column) -> Column:
                    def full(owner: Column) -> Column:
                        return F.concat(F.coalesce(F.try_element_at(aliases, owner), owner), F.lit("."), F.substring_index(ref, ".", -1))

                    return F.when(ref.contains("."), let(F.substring_index(ref, ".", 1), full)).otherwise(ref)

                return sqltext.sorted_set(F.transform(sqltext.column_refs(F.coalesce(piece, F.lit("")), given), name))

            return let(F.col("_aliases"), lambda aliases: let(F.col("_given"), lambda given: named(aliases, given)))

        pieces = {
            "columns_used": bare,
            "selected_columns": sqltext.select_list(bare),
            "where_columns": sqltext.clause(bare, "where"),
            "group_by_columns": sqltext.clause(bare, r"group\s+by"),
            "order_by_columns": sqltext.clause(bare, r"order\s+by"),
        }
        found = {
            "tables_used": sqltext.sorted_set(F.col("_refs")),
            "join_predicates": sqltext.join_predicates(text),
            "aggregation_functions": sqltext.aggregate_functions(bare),
            "literals_used": sqltext.literals(text),
        }
        by_clause = {n: F.when(good, qualified(piece)) for n, piece in pieces.items()}
        return {n: F.when(good, c) for n, c in found.items()} | {"parse_error": ~good} | by_clause

    return sqltext.with_features(log, sql, fields, shared=(shared, owners))


def distinct_texts(log: DataFrame, sql: str = "sql", by: list[str] = ()) -> DataFrame:
    """(sql, uses): each query text once. The count is combined before the shuffle, so hot texts are cheap.

    Texts are dealt to a given number of tasks, as they are few bytes that take long to read.
    """
    parts = wide_parts(log.sparkSession)
    return log.groupBy(*by, F.col(sql).alias("sql")).agg(F.count(F.lit(1)).alias("uses")).repartition(parts, "sql")


def join_edges(log: DataFrame, sql: str = "sql", by: list[str] = ()) -> DataFrame:
    """(left_column, right_column, uses): how often the log joins two columns, as table.column names in order."""
    equality = r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"

    def fields(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        predicates = F.when(good, F.array_join(sqltext.join_predicates(text), "\n"))
        return {
            "edges": F.regexp_extract_all(predicates, F.lit(equality), F.lit(0)),
            "aliases": sqltext.alias_map(sqltext.table_refs(bare), sqltext.table_aliases(bare)),
        }

    texts = sqltext.with_features(distinct_texts(log, sql, by), "sql", fields, marked=True)
    edges = texts.select(*by, "uses", "aliases", "quoted_names", F.explode("edges").alias("edge"))

    def end(table_group: int, column_group: int) -> Column:
        owner = F.regexp_extract("edge", equality, table_group)
        name = F.concat(F.coalesce(F.try_element_at("aliases", owner), owner), F.lit("."), F.regexp_extract("edge", equality, column_group))
        return F.when(F.size("quoted_names") > 0, sqltext.restored(name, F.col("quoted_names"), False)).otherwise(name)

    ends = edges.select(*by, "uses", end(1, 2).alias("a"), end(3, 4).alias("b"))
    return ends.groupBy(*by, F.least("a", "b").alias("left_column"), F.greatest("a", "b").alias("right_column")).agg(
        F.sum("uses").alias("uses")
    )


def item_frequencies(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(kind, name, uses): how many log rows use each table and column."""
    def fields(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        named = F.concat(
            F.transform(sqltext.table_names(bare), lambda n: F.struct(F.lit("table").alias("kind"), n.alias("name"))),
            F.transform(sqltext.column_names(bare), lambda n: F.struct(F.lit("column").alias("kind"), n.alias("name"))),
        )
        return {"items": F.when(good, named)}

    texts = sqltext.with_features(distinct_texts(log, sql), "sql", fields)
    return texts.select("uses", F.inline("items")).groupBy("kind", "name").agg(F.sum("uses").alias("uses"))


def top_joins(edges: DataFrame, k: int = 10) -> DataFrame:
    """(db_id, top_joins): the most used join predicates of each database."""
    ranked = top_per_group(edges, ["db_id"], [F.col("uses").desc(), F.col("left_column"), F.col("right_column")], k)
    entry = F.struct("rank", F.concat("left_column", F.lit(" = "), "right_column").alias("join"))
    return ranked.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["join"]).alias("top_joins"))


def column_log_support(columns: DataFrame, log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``query_log_support``: the share of log rows whose column names contain the column's name.

    A text that contains ``table.column`` also contains ``column``, so the bare name
    decides. The log is collapsed to distinct texts, and those to distinct lists of columns,
    before names are looked up in them.
    """
    def fields(text: Column, bare: Column, good: Column) -> dict[str, Column]:
        names = F.when(good, F.array_join(sqltext.column_names(bare), " "))
        return {"hay": F.lower(F.coalesce(names, F.lit("")))}

    read = sqltext.with_features(distinct_texts(log, sql), "sql", fields)
    lists = stable(read.groupBy("hay").agg(F.sum("uses").alias("uses")).withColumn("hay_id", F.col("hay")))
    log_rows = log.agg(F.count(F.lit(1))).scalar()
    needles = columns.select(F.lower("column_name").alias("needle")).distinct()
    used = contained_in(needles, lists, [], {"uses": F.sum("uses")})
    share = F.coalesce(F.try_divide(F.col("uses"), log_rows), F.lit(0.0))
    counted = columns.withColumn("needle", F.lower("column_name")).join(used, "needle", "left")
    return counted.withColumn("query_log_support", share).drop("needle", "uses")


def validate_samples(samples: DataFrame, known_databases: DataFrame, split: str = "train") -> DataFrame:
    """Add ``errors`` (empty for valid rows) and fill a missing question id with ``{split}_{row}``.

    ``samples`` has (row, question_id, db_id, question, SQL); ``row`` is the position in the
    source, which makes the generated id reproducible.
    """
    def missing(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) == ""

    known = known_databases.select("db_id").distinct().withColumn("_known", F.lit(True))
    checks = F.array(
        F.when(missing("db_id"), F.lit("missing db_id")),
        F.when(missing("question"), F.lit("missing question")),
        F.when(missing("SQL"), F.lit("missing SQL")),
        F.when(F.col("db_id").isNotNull() & F.col("_known").isNull(), F.lit("unknown database")),
        F.when(~missing("SQL") & sqltext.parse_error(sqltext.blanked(clean_sql(F.col("SQL")))), F.lit("SQL parsing failed")),
    )
    return (
        samples.join(known, "db_id", "left")
        .withColumn("errors", F.filter(checks, lambda e: e.isNotNull()))
        .withColumn("question_id", F.coalesce("question_id", F.concat(F.lit(f"{split}_"), F.col("row").cast("string"))))
        .drop("_known")
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (without the error list) and invalid rows."""
    return validated.filter(F.size("errors") == 0).drop("errors"), validated.filter(F.size("errors") > 0)

