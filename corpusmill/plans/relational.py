"""Relational coverage over the star tables: aggregates, joins of each kind, windows, set operations, rollups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..session import table


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    """Aggregates with a filter that reaches the scan."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def regional_revenue(spark, sf_dir):
    """A star join; small sides are broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("region").where("r_name = 'ASIA'").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    """Anti-join."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_orders_per_customer(spark, sf_dir):
    """Rank within a group; the pre-filter on the rank keeps the window's input small."""
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rn.cast("long").alias("rn")).where("rn <= 3")


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def flag_rollup(spark, sf_dir):
    """Rollup in one pass."""
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def nation_set_operations(spark, sf_dir):
    """Intersection and difference."""
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k"))
    return t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))
