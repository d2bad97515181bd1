"""Extracted records over the driver's tables: orders as records, their lines as list items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import dates
from foliospark.operators import extraction
from foliospark.plans.registry import query
from foliospark.session import load


@query("SELECT o_orderkey, o_orderpriority AS unwrapped, (o_orderpriority IS NOT NULL)::BIGINT + (o_orderkey % 3 <> 0)::BIGINT AS fields_with_value, (o_orderkey % 2 = 0)::BIGINT + (o_orderkey % 5 = 0)::BIGINT AS fields_with_bbox FROM orders")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.struct(F.col("o_orderpriority").alias("value"), F.when(k % 2 == 0, k).alias("bbox"))
    second = F.struct(F.when(k % 3 != 0, F.col("o_orderstatus")).alias("value"), F.when(k % 5 == 0, k).alias("bbox"))
    return load(spark, d, "orders").select("o_orderkey", extraction.unwrapped(first).alias("unwrapped"), *extraction.coverage({"a": first, "b": second}))


@query("SELECT o_orderpriority AS batch, count(*) AS total, count_if(o_orderstatus = 'F') AS succeeded, count_if(o_orderstatus = 'O') AS failed FROM orders GROUP BY o_orderpriority")
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed")
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(*extraction.batch_result(status))


@query("SELECT o_orderkey, field, 'GENERIC_002' AS rule_code, 'WARNING' AS status FROM (SELECT o_orderkey, 'a' AS field, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS v FROM orders UNION ALL SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'x' END FROM orders UNION ALL SELECT o_orderkey, 'c', o_totalprice::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'lines', CASE WHEN o_orderkey % 5 > 1 THEN 'x' END FROM orders) WHERE coalesce(v, '') = ''")
def empty_field_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_orderkey", F.when(k % 3 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 4 == 0, "").otherwise("x").alias("b"), F.col("o_totalprice").alias("c"), F.when(k % 5 == 0, F.array().cast("array<bigint>")).when(k % 5 > 1, F.array(k)).alias("lines"))
    return extraction.empty_fields(rows, "o_orderkey", ["a", "b", "c", "lines"])


@query("SELECT l_orderkey, 'jobs[' || (n - 1) || ']' AS field, 'GENERIC_003' AS rule_code, 'stated ' || coalesce(s, 'nothing') || ', computed ' || l_suppkey AS actual FROM (SELECT *, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey::VARCHAR END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE l_quantity >= 10 AND l_partkey <> l_suppkey")
def duration_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Unverified items (a null match, of small quantities here) pass."""
    match = F.when(F.col("l_quantity") >= 10, F.col("l_partkey") == F.col("l_suppkey"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", match.alias("match"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey").cast("string")).alias("stated"), F.col("l_suppkey").cast("string").alias("computed"))
    lists = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("jobs"))
    return extraction.duration_mismatches(lists, "l_orderkey", "jobs")


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, list_concat(CASE WHEN l_partkey % 2 = 0 THEN ['part'] ELSE [] END, list_concat(['quantity'], CASE WHEN l_suppkey % 3 = 0 THEN ['supplier'] ELSE [] END)) AS keys FROM lineitem),
a AS (SELECT l_orderkey, list_sort(list_distinct(flatten(list(keys)))) AS every FROM i GROUP BY l_orderkey)
SELECT l_orderkey, i, array_to_string(list_filter(every, lambda x: NOT list_contains(keys, x)), ',') AS missing FROM i JOIN a USING (l_orderkey) WHERE len(list_filter(every, lambda x: NOT list_contains(keys, x))) > 0""")
def missing_item_keys(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_compact(F.array(F.when(F.col("l_partkey") % 2 == 0, F.struct(F.lit("part"), F.lit(1))), F.struct(F.lit("quantity"), F.lit(1)), F.when(F.col("l_suppkey") % 3 == 0, F.struct(F.lit("supplier"), F.lit(1)))))
    rows = load(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", pairs.alias("p")).alias("x"))
    lists = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x")).select("l_orderkey", F.transform("x", lambda e: e["p"]).alias("x")).select("l_orderkey", F.transform("x", F.map_from_entries).alias("items"))
    return extraction.missing_keys(lists, "l_orderkey", "items").select("l_orderkey", F.col("i").cast("long").alias("i"), F.array_join("missing", ",").alias("missing"))


@query("""SELECT o_custkey, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN 10.5 + CASE WHEN o_orderkey % 2 = 0 THEN 2.25 ELSE 0 END ELSE o_shippriority_ END), 4) AS gross_total, round(sum(CASE WHEN o_orderkey % 5 = 0 THEN 100.5 ELSE 0 END), 4) AS hra_total, round(sum(1.5), 4) AS professional_tax_total, round(sum(CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 7) + (o_orderkey % 11) ELSE 0 END), 4) AS deductions_total
FROM (SELECT *, (o_orderkey % 1000)::DOUBLE AS o_shippriority_ FROM orders) GROUP BY o_custkey""")
def salary_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    entry = F.struct(
        F.when(k % 3 != 0, (k % 1000).cast("double")).alias("gross"), F.lit(10.5).alias("salary"), F.when(k % 2 == 0, 2.25).alias("perquisites"), F.lit(None).cast("double").alias("profits"),
        F.when(k % 5 == 0, 100.5).alias("hra"), F.lit(1.5).alias("professional_tax"), F.when(k % 4 != 0, F.array((k % 7).cast("double"), F.lit(None).cast("double"), (k % 11).cast("double"))).alias("deductions"),
    )
    people = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("e"))
    return people.select("o_custkey", *extraction.salary_income(F.col("e")))


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'P') > 0 THEN 'ITR2' ELSE 'ITR1' END AS itr_type, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'F') > 0 OR c_custkey % 9 = 0 THEN 'calculate' ELSE 'ask' END AS next_stage FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def tax_form(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    counts = load(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return counts.select("c_custkey", *extraction.return_type(F.col("p"), F.col("f"), F.col("c_custkey") % 9 == 0))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders")
def tax_dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd-MM-yyyy")).when(k == 2, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "MMM yyyy"))
    return load(spark, d, "orders").select("o_orderkey", dates.parsed(text, dates.TAX_FORMATS).alias("day"))


@query("SELECT 'price' AS \"column\", count(*) AS n_numbers, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 4) AS total FROM orders UNION ALL SELECT 'status', 0, NULL UNION ALL SELECT 'some', count(*) FILTER (o_orderkey % 2 = 0), sum(o_orderkey) FILTER (o_orderkey % 2 = 0)::DOUBLE FROM orders")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = load(spark, d, "orders").select(F.format_number("o_totalprice", 2).alias("price"), F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, k.cast("string")).otherwise("n/a").alias("some"))
    return extraction.numeric_columns(cells, ["price", "status", "some"])


@query("SELECT s_suppkey, sha256('sk-' || s_name) AS key_hash, substr('sk-' || s_name, 1, 10) AS key_prefix FROM supplier")
def hashed_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("sk-"), F.col("s_name"))
    return load(spark, d, "supplier").select("s_suppkey", F.sha2(key, 256).alias("key_hash"), F.substring(key, 1, 10).alias("key_prefix"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_rows, coalesce(hi, 0) > 400000 AS flagged FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate stays, with its rows and whether an issue names it."""
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    rows = orders.groupBy("c_custkey").agg(F.count("*").alias("n"))
    issues = orders.filter("o_totalprice > 400000").select("c_custkey").distinct().withColumn("hit", F.lit(True))
    people = load(spark, d, "customer").select("c_custkey", "c_name").join(rows, "c_custkey", "left").join(issues, "c_custkey", "left")
    return people.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("hit", F.lit(False)).alias("flagged"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(o_orderpriority)))), ',') AS kinds FROM orders GROUP BY o_custkey")
def united_kinds(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.collect_set("o_orderpriority").alias("p"))
    return both.select("o_custkey", F.array_join(F.array_sort(F.array_union("s", "p")), ",").alias("kinds"))


@query("""WITH d AS (SELECT c_custkey AS k, 'f' AS s, c_custkey % 11 = 0 AS bad, 1 AS n, round(c_acctbal, 2) AS salary, 0.0::DOUBLE AS interest, 0.0::DOUBLE AS sold FROM customer
UNION ALL SELECT o_custkey, 'd', o_orderkey % 13 = 0, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE o_orderkey % 3 END, 0, CASE WHEN o_orderkey % 3 >= 1 THEN o_totalprice ELSE 0 END, 0 FROM orders
UNION ALL SELECT o_custkey, 't', false, 1, 0, 0, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT k AS c_custkey, coalesce(sum(n) FILTER (s = 'f' AND NOT bad), 0)::BIGINT AS form16_entries, coalesce(sum(n) FILTER (s = 'd' AND NOT bad), 0)::BIGINT AS fd_interest_entries, coalesce(sum(n) FILTER (s = 't'), 0)::BIGINT AS stocks_entries, count(*) FILTER (bad) AS errors,
coalesce(round(sum(salary) FILTER (NOT bad), 2), 0) AS salary, coalesce(round(sum(interest) FILTER (NOT bad), 2), 0) AS interest, coalesce(round(sum(sold) FILTER (NOT bad), 2), 0) AS sold FROM d WHERE n > 0 GROUP BY k""")
def tax_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as employers' forms, orders as certificates of none to two deposits, lines as trades; some can't be read."""
    from foliospark.operators import profiles

    value = lambda c: F.struct(c.alias("value"), F.lit(None).cast("string").alias("bbox"))
    failed = lambda on: F.when(on, F.lit("unreadable"))
    k, c = F.col("o_orderkey"), load(spark, d, "customer")
    forms = c.select("c_custkey", F.col("c_custkey").alias("document_id"), failed(F.col("c_custkey") % 11 == 0).alias("error"), F.struct(value(F.col("c_name")).alias("employer_name"), value(F.col("c_acctbal").cast("string")).alias("salary")).alias("extracted"))
    entry = lambda n, x: F.struct(value(F.lit(n)).alias("bank_name"), x.alias("interest_earned"))
    two = F.slice(F.array(entry("first", F.col("o_totalprice").cast("string")), entry("second", F.lit("n/a"))), 1, (k % 3).cast("int"))
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    deposits = o.select("c_custkey", k.alias("document_id"), failed(k % 13 == 0).alias("error"), F.struct(two.alias("fd_entries")).alias("extracted"))
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice").join(o.select("o_orderkey", "c_custkey"), "o_orderkey")
    trades = lines.select("c_custkey", k.alias("document_id"), failed(F.lit(False)).alias("error"), F.struct(F.array(F.struct(F.col("l_extendedprice").alias("sell_value"))).alias("transactions")).alias("extracted"))
    every = profiles.stitched("c_custkey", form16=forms, fd_interest=deposits, stocks=trades)
    return profiles.totals(every, "c_custkey", {"salary": ("form16", "salary"), "interest": ("fd_interest", "interest_earned"), "sold": ("stocks", "sell_value")})
