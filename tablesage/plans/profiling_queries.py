"""Profiles of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesage.operators import profiling
from tablesage.operators.value_states import ValueStates
from tablesage.plans.inputs import COLUMNS, DB, STAR, cells_sql, columns_sql, select, star_tables, tables_of
from tablesage.plans.registry import query

EXTREMES = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({e}) AS VARCHAR) AS min_value, CAST(max({e}) AS VARCHAR) AS max_value FROM {t}"
    for t in STAR
    # Adding 0.0 keeps the oracle from answering -0.0 out of file statistics.
    for c, e in [(c, f"{c} + 0.0::DOUBLE" if k == "double" else c) for c, k in COLUMNS[t]]
)
RANKED = f"""freq AS (SELECT table_name, column_name, value, count(*) AS cnt FROM ({cells_sql(STAR)}) WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS rank FROM freq),
top AS (SELECT * FROM ranked WHERE rank <= 20)"""
SHAPE = r"""kinds AS (SELECT table_name, column_name, CASE WHEN v = '' THEN 'blank'
 WHEN regexp_full_match(v, '[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)') THEN 'numeric'
 WHEN regexp_full_match(v, '\d{4}[-/]\d{1,2}[-/]\d{1,2}') OR regexp_full_match(v, '\d{1,2}[-/]\d{1,2}[-/]\d{2,4}') THEN 'date'
 WHEN v IN ('y','n','yes','no','true','false','1','0','t','f') THEN 'boolean'
 WHEN length(v) <= 6 THEN 'code' ELSE 'text_phrase' END AS kind
 FROM (SELECT table_name, column_name, lower(trim(value)) AS v FROM top))
SELECT table_name, column_name, CASE WHEN avg((kind = 'numeric')::INT) > 0.8 THEN 'numeric' WHEN avg((kind = 'date')::INT) > 0.8 THEN 'date'
 WHEN avg((kind = 'boolean')::INT) > 0.8 THEN 'boolean' WHEN avg((kind = 'code')::INT) > 0.8 THEN 'code' ELSE 'text_phrase' END AS value_shape
FROM kinds GROUP BY table_name, column_name"""


@query("profile_table", f"""SELECT c.table_name, c.column_name, c.total_rows, c.null_count, c.null_ratio, c.distinct_count, e.min_value, e.max_value
FROM (SELECT table_name, column_name, count(*) AS total_rows, count(*) - count(value) AS null_count,
 CAST(count(*) - count(value) AS DOUBLE) / count(*) AS null_ratio, count(DISTINCT value) AS distinct_count
 FROM ({cells_sql(STAR)}) GROUP BY table_name, column_name) c JOIN ({EXTREMES}) e USING (table_name, column_name)""")
def profile_table(spark, sf_dir):
    return profiling.column_counts(ValueStates(tables_of(spark, sf_dir, STAR)))


@query("profile_topk", f"WITH {RANKED} SELECT table_name, column_name, CAST(rank AS INT) AS rank, value, cnt FROM top")
def profile_topk(spark, sf_dir):
    top = profiling.top_values(ValueStates(tables_of(spark, sf_dir, STAR)))
    return top.select("table_name", "column_name", F.posexplode("top_values").alias("at", "e")).select(
        "table_name", "column_name", (F.col("at") + 1).alias("rank"), "e.value", F.col("e.count").alias("cnt")
    )


@query("profile_value_shape", f"WITH {RANKED}, {SHAPE}")
def profile_value_shape(spark, sf_dir):
    top = profiling.top_values(ValueStates(tables_of(spark, sf_dir, STAR)))
    return top.select("table_name", "column_name", profiling.value_shape(F.col("top_values.value")).alias("value_shape"))


@query("profile_sketched")
def profile_sketched(spark, sf_dir):
    return profiling.profile_tables(star_tables(spark, sf_dir), DB, exact=False).select(
        "table_name", "column_name", "total_rows", "null_count", "distinct_count", "value_shape"
    )


@query("schema_ddl", f"""WITH {RANKED}, shown AS (SELECT table_name, column_name, string_agg('"' || value || '"', ', ' ORDER BY rank) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY rank) AS n FROM top WHERE value <> '') WHERE n <= 3
 GROUP BY table_name, column_name)
SELECT 'tpch' AS db_id, table_name, 'CREATE TABLE `' || table_name || '` (' || chr(10) ||
 string_agg('  `' || column_name || '` ' || data_type || coalesce(' /* Samples: ' || samples || ' */', ''), ',' || chr(10) ORDER BY ordinal)
 || chr(10) || ');' AS ddl FROM ({columns_sql(STAR)}) LEFT JOIN shown USING (table_name, column_name) GROUP BY table_name""")
def schema_ddl(spark, sf_dir):
    return profiling.schema_text(profiling.profile_tables(tables_of(spark, sf_dir, STAR), DB))


PROBES = """SELECT 'nation' AS table_name, 'n_name' AS column_name, c_name AS value FROM customer
UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'part', 'p_size', CAST(c_nationkey AS STRING) FROM customer"""


@query("value_exists", f"""WITH probes AS (SELECT DISTINCT * FROM ({PROBES})), cells AS (SELECT DISTINCT table_name, column_name, value FROM ({cells_sql(STAR)}))
SELECT p.table_name, p.column_name, p.value, c.value IS NOT NULL AS value_exists
FROM probes p LEFT JOIN cells c USING (table_name, column_name, value)""")
def value_exists(spark, sf_dir):
    tables = tables_of(spark, sf_dir, STAR)
    return profiling.values_exist(select(spark, sf_dir, PROBES, ["customer"]).distinct(), tables)
