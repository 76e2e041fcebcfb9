"""Column profiles from mergeable states of the columns' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.functions.binding import let
from tablesage.operators.numbering import top_per_group
from tablesage.operators.value_states import ValueStates, unite
from tablesage.session import stable
from tablesage.sources.catalog import column_metadata

# Fixed values of the value-shape rules.
NUMBER_TEXT = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"
DATE_TEXTS = [r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$", r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"]
BOOLEAN_TEXTS = ["y", "n", "yes", "no", "true", "false", "1", "0", "t", "f"]
CODE_LENGTH = 6
SHAPE_SHARE = 0.8

KEYS = ["table_name", "column_name"]
#: Values of a column that are asked for by a filter of its scan.
FEW = 1000


def column_counts(states: ValueStates) -> DataFrame:
    """Row, null and distinct counts and the extremes of every column."""
    spark = next(iter(states.tables.values())).sparkSession
    every = spark.range(len(states.columns)).select(F.col("id").cast("int").alias("column_no"))  # tables without rows have no states
    counts = states.names(every.join(states.measures(), "column_no", "left").join(states.distinct_counts(), "column_no", "left"))
    known = counts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "null_count", "distinct_count")})
    return known.withColumn("null_ratio", F.coalesce(F.try_divide(F.col("null_count"), F.col("total_rows")), F.lit(0.0)))


def top_values(states: ValueStates, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values per column in order, ties broken by the value."""
    ranked = top_per_group(states.top(k), ["column_no"], [F.col("count").desc(), F.col("value")], k)
    entries = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    listed = ranked.groupBy("column_no").agg(
        F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))).alias("top_values")
    )
    return states.names(listed)


def value_shape(values: Column) -> Column:
    """numeric, date, boolean, code or text_phrase: the first kind that over 80 % of all values are of."""
    texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.btrim(v)))

    def kind(t: Column) -> Column:
        return (
            F.when(t == "", F.lit("blank"))
            .when(t.rlike(NUMBER_TEXT), F.lit("numeric"))
            .when(t.rlike(DATE_TEXTS[0]) | t.rlike(DATE_TEXTS[1]), F.lit("date"))
            .when(t.isin(BOOLEAN_TEXTS), F.lit("boolean"))
            .when(F.length(t) <= CODE_LENGTH, F.lit("code"))
            .otherwise(F.lit("text_phrase"))
        )

    def shape(kinds: Column) -> Column:
        found = F.lit("text_phrase")
        for name in ["code", "boolean", "date", "numeric"]:
            share = F.try_divide(F.size(F.filter(kinds, _equals(name))), F.size(kinds))
            found = F.when(share > SHAPE_SHARE, F.lit(name)).otherwise(found)
        return found

    return let(F.transform(texts, kind), shape)


def _equals(name: str):
    return lambda x: x == name


def profile_tables(
    tables: dict[str, DataFrame], db_id: str, k: int = 20, exact: bool = True, states: ValueStates | None = None
) -> DataFrame:
    """One profile row per column of every table.

    The states are gathered when this is called; a caller that needs the values too passes its own. ``exact=False`` takes
    sketches in one wide aggregate per table instead, with approximate distinct and value counts.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = column_metadata(spark, tables, db_id).drop("not_null", "primary_key")
    if exact:
        states = ValueStates(tables) if states is None else states
        measured = column_counts(states).join(top_values(states, k), KEYS, "left")
    else:
        measured = unite([_sketched(t, df, k) for t, df in tables.items()])
    values = F.coalesce(F.col("top_values"), F.array().cast("array<struct<value:string,count:bigint>>"))
    return (
        columns.join(measured, KEYS, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "null_count", "distinct_count")})
        .withColumns({"null_ratio": F.coalesce("null_ratio", F.lit(0.0)), "top_values": values})
        .withColumns(
            {
                "value_shape": value_shape(F.col("top_values.value")),
                "example_values": F.slice(F.col("top_values.value"), 1, 5),
                "short_description": F.lit("").cast("string"),
                "possible_semantic_type": F.lit("").cast("string"),
            }
        )
    )


def _sketched(table: str, df: DataFrame, k: int) -> DataFrame:
    """Approximate distinct counts and top values of all columns in one scan without a value shuffle."""
    measures = []
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        measures += [
            F.count(text).alias(f"n_{i}"),
            F.approx_count_distinct(text).alias(f"d_{i}"),
            F.expr(f"approx_top_k(cast(`{c}` as string), {k})").alias(f"t_{i}"),
            F.min(F.col(f"`{c}`")).cast("string").alias(f"lo_{i}"),
            F.max(F.col(f"`{c}`")).cast("string").alias(f"hi_{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("total_rows"), *measures)

    def entry(i: int, c: str) -> Column:
        nulls = F.col("total_rows") - F.col(f"n_{i}")
        known = F.filter(F.col(f"t_{i}"), lambda e: e["item"].isNotNull())
        return F.struct(
            F.lit(c).alias("column_name"),
            F.col("total_rows").alias("total_rows"),
            nulls.alias("null_count"),
            F.coalesce(F.try_divide(nulls, F.col("total_rows")), F.lit(0.0)).alias("null_ratio"),
            F.col(f"d_{i}").alias("distinct_count"),
            F.transform(known, lambda e: F.struct(e["item"].alias("value"), e["count"].alias("count"))).alias("top_values"),
            F.col(f"lo_{i}").alias("min_value"),
            F.col(f"hi_{i}").alias("max_value"),
        )

    return wide.select(F.lit(table).alias("table_name"), F.inline(F.array(*[entry(i, c) for i, c in enumerate(df.columns)])))


def schema_text(profiles: DataFrame, samples: int = 3) -> DataFrame:
    """(db_id, table_name, ddl): a CREATE TABLE text per table with sample values as comments."""
    filled = F.slice(F.filter(F.col("top_values.value"), lambda v: v != ""), 1, samples)
    shown = F.array_join(F.transform(filled, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    comment = F.when(F.size(filled) > 0, F.concat(F.lit(" /* Samples: "), shown, F.lit(" */"))).otherwise("")
    line = F.concat(F.lit("  `"), "column_name", F.lit("` "), F.coalesce("data_type", F.lit("TEXT")), comment)
    return _create_texts(profiles, line, "`")


def plain_schema_text(profiles: DataFrame) -> DataFrame:
    """(db_id, table_name, ddl) with names and types only."""
    line = F.concat(F.lit('  "'), "column_name", F.lit('" '), F.coalesce("data_type", F.lit("TEXT")))
    return _create_texts(profiles, line, "")


def _create_texts(profiles: DataFrame, line: Column, quote: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda e: e["line"])
    head = F.concat(F.lit(f"CREATE TABLE {quote}"), "table_name", F.lit(f"{quote} (\n"))
    return profiles.groupBy("db_id", "table_name").agg(
        F.concat(head, F.array_join(lines, ",\n"), F.lit("\n);")).alias("ddl")
    )


def database_schema_text(table_texts: DataFrame, between: str = "\n\n") -> DataFrame:
    """(db_id, ddl): the table texts of a database joined in table order."""
    texts = F.array_sort(F.collect_list(F.struct("table_name", "ddl")))
    return table_texts.groupBy("db_id").agg(F.array_join(F.transform(texts, lambda e: e["ddl"]), between).alias("ddl"))


def values_exist(probes: DataFrame, tables: dict[str, DataFrame], few: int = FEW) -> DataFrame:
    """Add ``value_exists`` to (table_name, column_name, value) probes: is there a cell with this text?

    Only columns that some probe asks for are scanned, each by itself. Where at most ``few`` different values are asked, the
    scan is filtered by them in the column's own type, which reaches the file's statistics; where there are more, its cells are
    semi-joined with the probes. Which way is decided when this is called, from one count for each asked column.
    """
    keys = [*KEYS, "value"]
    asked = stable(probes.where("value IS NOT NULL").select(*keys).distinct())
    columns = [(table, field) for table, df in tables.items() for field in df.schema.fields]
    known = asked.sparkSession.createDataFrame([(t, f.name) for t, f in columns], "table_name string, column_name string")
    counts = {(r.table_name, r.column_name): r["count"] for r in asked.join(known, KEYS, "left_semi").groupBy(*KEYS).count().collect()}
    found = []
    for table, field in columns:
        n = counts.get((table, field.name), 0)
        if n:
            wanted = asked.where((F.col("table_name") == table) & (F.col("column_name") == field.name)).select("value")
            found.append(_cells_among(tables[table], field, wanted, n <= few).select(F.lit(table).alias("table_name"), F.lit(field.name).alias("column_name"), "value"))
    if not found:
        return probes.withColumn("value_exists", F.lit(False))
    met = unite(found).withColumn("value_exists", F.lit(True))
    return probes.join(met, keys, "left").withColumn("value_exists", F.coalesce("value_exists", F.lit(False)))


def _cells_among(table: DataFrame, field: T.StructField, wanted: DataFrame, few: bool) -> DataFrame:
    """(value): the different texts of a column's cells that are among ``wanted`` (value)."""
    column = F.col(f"`{field.name.replace('`', '``')}`")
    plain = isinstance(field.dataType, (T.StringType, T.IntegralType, T.DecimalType, T.DateType))
    if few and plain:  # texts that are no value of the type, or are written in another way than the type's, are in no cell
        typed = wanted.select(F.col("value").try_cast(field.dataType).alias("typed")).where("typed IS NOT NULL")
        listed = [r.typed for r in typed.collect()]
        table = table.where(column.isin(listed)) if listed else table.limit(0)
    return table.select(column.cast("string").alias("value")).join(wanted, "value", "left_semi").distinct()
