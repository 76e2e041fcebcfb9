"""Inputs derived from the given tables: questions, a query log, executed candidates.

The SQL texts are valid in Spark and in other engines, so both sides of a check build the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.operators.numbering import Along, numbered
from tablesage.sources.catalog import spread

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
LINKED = STAR
DB = "tpch"

# Column names and types of the star schema, for SQL texts that list every column.
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
        ("p_retailprice", "double"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
        ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
}

QST = """SELECT CAST(p_partkey AS STRING) AS question_id, 'tpch' AS db_id,
 concat('How many ', p_name, ' parts of brand ''', p_brand, ''' were sold in segment ', c_mktsegment, '?') AS question,
 concat('type refers to p_type = ''', p_type, '''') AS evidence
FROM part JOIN customer ON p_partkey = c_custkey"""

QLOG = """SELECT CAST(o_orderkey AS STRING) AS question_id, CASE o_orderkey % 6
 WHEN 0 THEN concat('SELECT o.o_totalprice FROM orders AS o WHERE o.o_custkey = ', CAST(o_custkey AS STRING))
 WHEN 1 THEN concat('SELECT COUNT(DISTINCT c.c_name) FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = ''', o_orderstatus, '''')
 WHEN 2 THEN 'SELECT n.n_name, SUM(s.s_acctbal) FROM supplier AS s JOIN nation AS n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY SUM(s.s_acctbal) DESC LIMIT 3'
 WHEN 3 THEN concat('SELECT DISTINCT p.p_brand FROM part AS p WHERE p.p_size > ', CAST(o_custkey % 50 AS STRING))
 WHEN 4 THEN 'SELECT r.r_name, MAX(c.c_acctbal) FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey JOIN customer AS c ON n.n_nationkey = c.c_nationkey GROUP BY r.r_name'
 ELSE concat('SELECT CAST(l.l_extendedprice AS REAL) / l.l_quantity FROM lineitem AS l WHERE l.l_orderkey = ', CAST(o_orderkey AS STRING), ' ORDER BY l.l_shipdate ASC LIMIT 1') END AS sql
FROM orders"""

CAND_COLUMNS = """user_id AS question_id, concat('db_', CAST(user_id % 5 AS STRING)) AS db_id, event_id AS candidate_id,
 CASE event_type WHEN 'click' THEN 'metadata_constrained_generator' WHEN 'view' THEN 'evidence_focused_generator'
  WHEN 'purchase' THEN 'reasoning_generator' WHEN 'signup' THEN 'icl_generator' ELSE 'simple_generator' END AS source,
 event_type <> 'error' AS success,
 CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'no such column: x'
      WHEN event_id % 3 = 1 THEN 'no such table: t' ELSE 'near "FROM": syntax error' END AS error,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 4 END AS row_count,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1 + event_id % 3 AS INT) END AS column_count,
 value / 100 AS runtime_sec, CAST(event_id % 3 AS INT) AS num_repairs,
 event_type = 'purchase' AND value > 20 AS is_correct, props"""

# The oracle numbers candidates with one window per question; Spark does it in chunks.
CAND = f"""SELECT q.*, row_count = 0 AS is_empty,
 CASE WHEN success THEN concat(CAST(row_count AS STRING), '|', CAST(column_count AS STRING)) ELSE 'failed' END AS result_key
FROM (SELECT {CAND_COLUMNS},
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos FROM events) q"""

INTENT = """SELECT CAST(p_partkey AS STRING) AS question_id, 'tpch' AS db_id, 'part name and brand' AS output_phrase,
 concat('customer mktsegment ', c_mktsegment) AS filter_text, p_name AS literal_1, p_brand AS literal_2
FROM part JOIN customer ON p_partkey = c_custkey"""

EVENTS_PER_CHUNK = 1 << 20
LOG_ROWS = 200_000


_READ: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan of one given table; its schema is looked up once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READ:
        _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READ[key]


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as :func:`spread` leaves it, for queries with much work per row."""
    key = (spark.sparkContext.applicationId, sf_dir, name, "spread")
    if key not in _READ:
        _READ[key] = spread(table(spark, sf_dir, name))
    return _READ[key]


def tables_of(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}


class Given(dict):
    """The given tables by name, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def given(spark: SparkSession, sf_dir: str) -> Given:
    return Given(spark, sf_dir)


def select(spark: SparkSession, sf_dir: str, sql: str, names: list[str]) -> DataFrame:
    """A SQL text over given tables, which it sees as views."""
    for name in names:
        read = table if name == "events" else spread_table
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, QST, ["part", "customer"])


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, QLOG, ["orders"])


def query_log_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in parts of at most about ``LOG_ROWS`` rows, for queries that read every text by itself."""
    orders = table(spark, sf_dir, "orders")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // LOG_ROWS))
    orders.repartition(parts).createOrReplaceTempView("orders")
    return spark.sql(QLOG)


def unnumbered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without positions, for operators that do not look at positions."""
    key = "CASE WHEN success THEN concat(CAST(row_count AS STRING), '|', CAST(column_count AS STRING)) ELSE 'failed' END AS result_key"
    return select(spark, sf_dir, f"SELECT {CAND_COLUMNS} FROM events", ["events"]).selectExpr("*", "row_count = 0 AS is_empty", key)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = [Along(F.floor(F.col("candidate_id") / EVENTS_PER_CHUNK))]
    rows = numbered(unnumbered_candidates(spark, sf_dir), ["question_id"], chunk, [F.col("candidate_id")], "pos")
    return rows.withColumn("pos", F.col("pos").cast("int"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, INTENT, ["part", "customer"]).select(
        "question_id", "db_id", "output_phrase", F.array("filter_text").alias("filter_phrases"),
        F.array("literal_1", "literal_2").alias("literals"),
    )


def linked_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spread_table(spark, sf_dir, name) for name in LINKED}


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spread_table(spark, sf_dir, name) for name in STAR}


def cells_sql(tables: list[str]) -> str:
    """SQL for (table_name, column_name, ordinal, data_type, value as text), one row per cell."""
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{kind}' AS data_type, CAST({c} AS VARCHAR) AS value FROM {t}"
        for t in tables
        for i, (c, kind) in enumerate(COLUMNS[t])
    )


def columns_sql(tables: list[str]) -> str:
    """SQL for (table_name, column_name, ordinal, data_type)."""
    rows = ", ".join(f"('{t}', '{c}', {i}, '{k}')" for t in tables for i, (c, k) in enumerate(COLUMNS[t]))
    return f"SELECT * FROM (VALUES {rows}) AS v(table_name, column_name, ordinal, data_type)"
