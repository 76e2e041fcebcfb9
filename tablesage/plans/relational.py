"""The relational operators that candidate queries are made of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.functions.compat import in_years, loose_real, ratio, year_text
from tablesage.operators.numbering import Along
from tablesage.operators.ordering import positions
from tablesage.plans.inputs import given
from tablesage.plans.registry import query
from tablesage.session import shared_folder
from tablesage.sources.jsonio import read_json_lines, write_json_lines


@query("jsonl_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir)["customer"].select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_json_lines(rows, path)
    return read_json_lines(spark, path, rows.schema)


@query("rel_scan_filter", """SELECT o_orderkey, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_orderstatus <> 'O') AND o_totalprice >= 1000 AND NOT o_custkey < 100""")
def rel_scan_filter(spark, sf_dir):
    o = given(spark, sf_dir)["orders"]
    kept = ((o.o_orderstatus == "F") | (o.o_orderstatus != "O")) & (o.o_totalprice >= 1000) & ~(o.o_custkey < 100)
    return o.filter(kept).select("o_orderkey", "o_totalprice")


@query("rel_project_expr", "SELECT p_partkey, p_size + 1 AS next_size, round(p_retailprice * 2, 2) AS double_price FROM part")
def rel_project_expr(spark, sf_dir):
    return given(spark, sf_dir)["part"].select(
        "p_partkey", (F.col("p_size") + 1).alias("next_size"), F.round(F.col("p_retailprice") * 2, 2).alias("double_price")
    )


@query("rel_null_filter", """SELECT c_custkey, o_orderkey IS NULL AS without_orders FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
WHERE c_name IS NOT NULL""")
def rel_null_filter(spark, sf_dir):
    t = given(spark, sf_dir)
    first = t["orders"].groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    joined = t["customer"].filter(F.col("c_name").isNotNull()).join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("o_orderkey").isNull().alias("without_orders"))


@query("rel_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def rel_ilike(spark, sf_dir):
    return given(spark, sf_dir)["part"].filter(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@query("rel_between_in", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')""")
def rel_between_in(spark, sf_dir):
    rows = given(spark, sf_dir)["lineitem"].filter(F.col("l_quantity").between(10, 12) & F.col("l_returnflag").isin("A", "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("rel_inner_join", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def rel_inner_join(spark, sf_dir):
    t = given(spark, sf_dir)
    return t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("rel_left_join", """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey""")
def rel_left_join(spark, sf_dir):
    t = given(spark, sf_dir)
    # Orders are counted before the join: one row per customer crosses it instead of every order.
    counted = t["orders"].groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    joined = t["customer"].join(counted, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("rel_semi_join", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)""")
def rel_semi_join(spark, sf_dir):
    t = given(spark, sf_dir)
    big = t["orders"].filter(F.col("o_totalprice") > 300000)
    there = t["nation"].filter(F.col("n_regionkey") == 1)
    c = t["customer"].join(there, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return c.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("rel_scalar_subquery", """SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)
OR p_partkey = (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 1)""")
def rel_scalar_subquery(spark, sf_dir):
    p = given(spark, sf_dir)["part"]
    mean = p.agg(F.avg("p_retailprice")).scalar()
    cheapest = p.orderBy("p_retailprice", "p_partkey").limit(1).select("p_partkey").scalar()
    return p.filter((F.col("p_retailprice") > mean) | (F.col("p_partkey") == cheapest)).select("p_partkey", "p_retailprice")


@query("rel_cte", """WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS customers, max(total) AS most FROM (SELECT * FROM spent WHERE total > 500000) AS s
JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def rel_cte(spark, sf_dir):
    t = given(spark, sf_dir)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    spent = t["orders"].groupBy("o_custkey").agg(total.alias("total")).filter(F.col("total") > 500000)
    joined = spent.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.max("total").alias("most"))


@query("rel_agg_global", """SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, round(avg(l_quantity), 6) AS quantity,
 min(l_shipdate) AS first_ship, max(l_discount) AS top_discount FROM lineitem""")
def rel_agg_global(spark, sf_dir):
    return given(spark, sf_dir)["lineitem"].agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
        F.round(F.avg("l_quantity"), 6).alias("quantity"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_discount").alias("top_discount"),
    )


@query("rel_group_having", """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 9""")
def rel_group_having(spark, sf_dir):
    grouped = given(spark, sf_dir)["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return grouped.filter(F.col("n") > 9)


@query("rel_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def rel_distinct(spark, sf_dir):
    return given(spark, sf_dir)["part"].select("p_brand", "p_type").distinct()


@query("rel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def rel_topk(spark, sf_dir):
    o = given(spark, sf_dir)["orders"].select("o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("rel_window_rank", """SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS place,
 rank() OVER (ORDER BY c_acctbal DESC) AS place_overall FROM customer""")
def rel_window_rank(spark, sf_dir):
    # Ranges of the balances are sampled, so neither a large segment nor a frequent balance nor the overall rank is one task's work.
    c = given(spark, sf_dir)["customer"].select("c_custkey", "c_mktsegment", "c_acctbal")
    order = [Along(F.col("c_acctbal"), descending=True)]
    placed = positions(c, ["c_mktsegment"], order, "place", start=1, ties=True)
    return positions(placed, [], order, "place_overall", start=1, ties=True).drop("c_acctbal")


@query("rel_cast_ratio", """SELECT l_returnflag, l_linestatus,
 CAST(count(CASE WHEN l_discount > 0.05 THEN 1 END) AS DOUBLE) / nullif(count(*), 0) AS discounted_share,
 CAST(sum(CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE)) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def rel_cast_ratio(spark, sf_dir):
    return given(spark, sf_dir)["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(
        ratio(F.count(F.when(F.col("l_discount") > 0.05, 1)), F.count(F.lit(1))).alias("discounted_share"),
        F.sum(loose_real(F.col("l_quantity").cast("string"))).alias("quantity"),
    )


@query("rel_year_filter", """SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders
WHERE strftime(o_orderdate, '%Y') BETWEEN '1996' AND '1998' GROUP BY 1""")
def rel_year_filter(spark, sf_dir):
    day = F.col("o_orderdate")
    rows = given(spark, sf_dir)["orders"].filter(in_years(day, 1996, 1998))  # a range of the column itself, which reaches the scan
    return rows.groupBy(year_text(day).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("rel_scalar_funcs", """SELECT s_suppkey, abs(s_acctbal) AS owed, coalesce(nullif(s_nationkey, 0), -1) AS nation,
 concat(s_name, '/', CAST(s_nationkey AS VARCHAR)) AS tag, replace(s_name, 'Supplier', 'S') AS short, substr(s_name, 1, 4) AS start FROM supplier""")
def rel_scalar_funcs(spark, sf_dir):
    return given(spark, sf_dir)["supplier"].select(
        "s_suppkey", F.abs("s_acctbal").alias("owed"), F.coalesce(F.nullif(F.col("s_nationkey"), F.lit(0)), F.lit(-1)).alias("nation"),
        F.concat("s_name", F.lit("/"), F.col("s_nationkey").cast("string")).alias("tag"),
        F.replace("s_name", F.lit("Supplier"), F.lit("S")).alias("short"), F.substring("s_name", 1, 4).alias("start"),
    )
