import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesage.operators import profiling
from tablesage.operators.value_states import ValueStates, extremes_of
from tablesage.sources import catalog


def profiles(spark, rows, schema, **kwargs):
    found = profiling.profile_tables({"t": spark.createDataFrame(rows, schema)}, "db", **kwargs).collect()
    return {r.column_name: r for r in found}


def test_empty_table_and_all_null_column(spark):
    empty = profiles(spark, [], "a int, b string")
    assert empty["a"].total_rows == 0 and empty["a"].null_ratio == 0.0 and empty["a"].distinct_count == 0
    assert empty["b"].value_shape == "text_phrase"
    nulls = profiles(spark, [(None, "x"), (None, "y")], "a int, b string")
    assert nulls["a"].null_ratio == 1.0 and nulls["a"].min_value is None and nulls["a"].top_values == []
    assert nulls["b"].distinct_count == 2


def test_typed_extremes_and_ties(spark):
    p = profiles(spark, [(9, "b"), (10, "a"), (10, "b"), (9, "a"), (100, "c")], "n bigint, s string")
    assert (p["n"].min_value, p["n"].max_value) == ("9", "100")
    assert [v.value for v in p["s"].top_values] == ["a", "b", "c"]
    assert p["s"].example_values == ["a", "b", "c"]


def test_sketches_agree_on_small_tables(spark):
    rows = [(i % 3, f"v{i % 5}") for i in range(30)]
    exact = profiles(spark, rows, "n int, s string")
    rough = profiles(spark, rows, "n int, s string", exact=False)
    for name in ("n", "s"):
        assert exact[name].total_rows == rough[name].total_rows
        assert exact[name].distinct_count == rough[name].distinct_count
        assert exact[name].min_value == rough[name].min_value
        assert {v.value for v in exact[name].top_values} == {v.value for v in rough[name].top_values}


def shape(spark, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    return df.select(profiling.value_shape(F.col("v"))).first()[0]


def test_value_shapes(spark):
    assert shape(spark, ["1", "0", "1e5", "1_000", "nan", " 2.5 "]) == "numeric"
    assert shape(spark, ["1d", "2d"]) == "code"
    assert shape(spark, ["2020-01-01", "1/2/99"]) == "date"
    assert shape(spark, ["yes", "no", "t"]) == "boolean"
    assert shape(spark, ["1", "2", "3", "4", "long text here"]) == "text_phrase"  # exactly 0.8 is not enough
    assert shape(spark, ["abc", "", "", "", ""]) == "text_phrase"  # blanks count in the denominator
    assert shape(spark, []) == "text_phrase"


def test_schema_texts(spark):
    tables = {"t": spark.createDataFrame([(1, ""), (2, "x")], "a int, b string")}
    found = profiling.profile_tables(tables, "db")
    text = profiling.schema_text(found).first().ddl
    assert text == 'CREATE TABLE `t` (\n  `a` int /* Samples: "1", "2" */,\n  `b` string /* Samples: "x" */\n);'
    assert profiling.plain_schema_text(found).first().ddl == 'CREATE TABLE t (\n  "a" int,\n  "b" string\n);'


def test_catalog(spark):
    df = spark.createDataFrame([(1,)], "a int")
    df.createOrReplaceTempView("catalog_probe")
    df.createOrReplaceTempView("sqlite_hidden")
    names = {r.table_name for r in catalog.list_tables(spark).collect()}
    assert "catalog_probe" in names and "sqlite_hidden" not in names
    assert "sqlite_hidden" in {r.table_name for r in catalog.list_tables(spark, hidden_prefix=None).collect()}
    meta = catalog.column_metadata(spark, {"t": df}, "db").first()
    assert (meta.column_name, meta.data_type, meta.primary_key) == ("a", "int", None)


def test_decimals_keep_every_digit(spark):
    rows = [(Decimal("12345678901234567890.12"),), (Decimal("12345678901234567891.13"),), (None,)]
    p = profiles(spark, rows, "d decimal(30,2)")["d"]
    assert (p.min_value, p.max_value) == ("12345678901234567890.12", "12345678901234567891.13")
    assert (p.distinct_count, p.null_count) == (2, 1)


def test_only_fingerprints_of_flat_columns_are_shuffled(spark):
    """Extremes exchange one row a task; distinct counts of flat columns exchange two numbers a value, no text."""
    df = spark.range(3000).selectExpr("concat('name of ', id) AS name", "id % 3 AS few").repartition(2)
    states = ValueStates({"t": df}, capacity=50, rows_at_once=500)
    assert set(states.slack) == {0}
    wide = extremes_of(df, [(0, df.schema["name"])], 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" in wide and "hashpartitioning" not in wide
    assert states.flat.columns == ["column_no", "h1", "h2", "count"]
    assert {r.column_name: (r.min_value, r.max_value, r.distinct_count) for r in profiling.column_counts(states).collect()} == {
        "name": ("name of 0", "name of 999", 3000), "few": ("0", "2", 3),
    }


def columns_of(draw, n):
    """Columns of every sort: few values, one value most of the time, flat, all different, many ties above one, text and reals."""
    few = [draw.choice("abc") if draw.random() < 0.9 else None for _ in range(n)]
    head = [0 if draw.random() < 0.5 else draw.randrange(10**6) for _ in range(n)]
    flat = [f"w{draw.randrange(n // 2 + 1)}" for _ in range(n)]
    keys = draw.sample(range(10**9), n)
    twice = [float(i // 2) for i in range(n)]
    odd = [draw.choice(["", "é", " ", "x" * 300]) if draw.random() < 0.4 else str(i) for i in range(n)]
    return list(zip(few, head, flat, keys, twice, odd, strict=True))


@pytest.mark.parametrize("n,capacity,rows_at_once,ties", [(300, 8192, 10**6, 1000), (400, 12, 40, 1000), (400, 12, 40, 3), (300, 4, 25, 0), (0, 4, 25, 0)])
def test_states_against_plain_counts(spark, n, capacity, rows_at_once, ties):
    rows = columns_of(random.Random(n + capacity + ties), n)
    df = spark.createDataFrame(rows, "few string, head int, flat string, keyed long, twice double, odd string").repartition(3)
    states = ValueStates({"t": df, "u": df.select("flat")}, capacity=capacity, rows_at_once=rows_at_once, ties=ties)
    top = {(r.table_name, r.column_name): [tuple(v) for v in r.top_values] for r in profiling.top_values(states, 20).collect()}
    counted = profiling.column_counts(states).collect()
    distinct = {(r.table_name, r.column_name): r.distinct_count for r in counted}
    values = {}
    for r in states.distinct_values().collect():
        values.setdefault((r.table_name, r.column_name), set()).add(r.value)
    for i, name in enumerate(df.columns):
        measured = {r.column_name: r for r in counted if r.table_name == "t"}[name]
        given = [r[i] for r in rows if r[i] is not None]
        order = (lambda v: v.encode()) if name in ("few", "flat", "odd") else None
        assert (measured.total_rows, measured.null_count) == (n, n - len(given))
        assert (measured.min_value, measured.max_value) == ((str(min(given, key=order)), str(max(given, key=order))) if given else (None, None))
        plain = Counter(str(r[i]) for r in rows if r[i] is not None)
        for table in ["t", "u"] if name == "flat" else ["t"]:
            assert top.get((table, name), []) == sorted(plain.items(), key=lambda x: (-x[1], x[0].encode()))[:20], name
            assert distinct[(table, name)] == len(plain)
            assert values.get((table, name), set()) == set(plain)
    if n and capacity < 20:
        assert states.slack and len(states.slack) < 7  # both ways were taken


@pytest.mark.parametrize("few", [0, 1000])
def test_values_exist(spark, tmp_path, few):
    cells = [("a", 5, Decimal("1.50"), 0.5), ("b ", None, Decimal("2.00"), 1e10), (None, 7, None, None)]
    spark.createDataFrame(cells, "s string, n int, d decimal(9,2), x double").write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t")), "u": spark.createDataFrame([], "s string")}
    asked = [("t", "s", "a", True), ("t", "s", "b", False), ("t", "n", "5", True), ("t", "n", "05", False), ("t", "n", "x", False), ("t", "d", "1.50", True),
             ("t", "d", "1.5", False), ("t", "x", "0.5", True), ("t", "x", "1.0E10", True), ("t", "none", "a", False), ("v", "s", "a", False), ("u", "s", "a", False),
             ("t", "s", None, False), ("t", "s", "a", True)]
    found = profiling.values_exist(spark.createDataFrame([r[:3] for r in asked], "table_name string, column_name string, value string"), tables, few)
    assert sorted(map(str, found.collect())) == sorted(f"Row(table_name={t!r}, column_name={c!r}, value={v!r}, value_exists={e})" for t, c, v, e in asked)
    plan = profiling.values_exist(spark.createDataFrame([("t", "n", "5")], "table_name string, column_name string, value string"), tables, few)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n:int>" in plan and "ReadSchema: struct<s" not in plan
    assert ("EqualTo(n,5)" in plan or "In(n, [5])" in plan) == (few > 0)
