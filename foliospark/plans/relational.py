"""Set operations, generic aggregates and windows over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import load


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT n_name, r_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    where = load(spark, d, "nation").join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    who = load(spark, d, "customer").join(where, F.col("n_nationkey") == F.col("c_nationkey"))
    return load(spark, d, "orders").join(who, F.col("c_custkey") == F.col("o_custkey")).groupBy("n_name", "r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").distinct().join(big, "c_custkey", "left_anti")


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(load(spark, d, "customer").select(F.col("c_nationkey").alias("k")))


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def widened_union(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def content_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lead(o_orderkey) OVER w AS next_order, o_totalprice - lag(o_totalprice) OVER w AS change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.round(F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", running.alias("running"), F.lead("o_orderkey").over(order).alias("next_order"), (F.col("o_totalprice") - F.lag("o_totalprice").over(order)).alias("change"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 500 by key, numbered over key ranges of a fixed width so that no task holds all rows: counts of the
    ranges before give each range its start."""
    width = 1 << 16
    rows = load(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / width).alias("range"))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("range").orderBy("o_orderkey")) - 1).join(base, "range")
    return placed.select("o_orderkey", F.floor((F.col("base") + F.col("i")) / 500).alias("batch"))
