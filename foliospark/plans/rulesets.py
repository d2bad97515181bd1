"""Rulesets and scores of whole extractions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import adapters, records, validate
from foliospark.plans.registry import query
from foliospark.session import load

RESULT = "SELECT k AS c_custkey, field, rule_code, status, status = 'FAIL' AND blocks AS blocking FROM r WHERE status IS NOT NULL"


def by_rest(k: Column, *values: str | None) -> Column:
    """values[k % n] as a text."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))


def results(df: DataFrame, kind: str) -> DataFrame:
    done = records.judged(df, kind, "c_custkey", F.lit("2024-01-01").cast("date"))
    return done.select("c_custkey", F.explode("results").alias("r")).select("c_custkey", "r.field", "r.rule_code", "r.status", "r.blocking")


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
SELECT k, 'gstin' AS field, 'VAL_301' AS rule_code, CASE k % 3 WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS status, true AS blocks FROM c
UNION ALL SELECT k, 'legal_name', 'VAL_301', 'PASS', true FROM c UNION ALL SELECT k, 'filing_period', 'VAL_301', CASE k % 5 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, true FROM c
UNION ALL SELECT k, 'return_type', 'VAL_301', 'PASS', true FROM c UNION ALL SELECT k, 'total_tax_liability', 'VAL_301', CASE k % 3 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c
UNION ALL SELECT k, 'gstin', 'VAL_203', CASE k % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END, true FROM c
UNION ALL SELECT k, 'total_tax', 'VAL_103', CASE k % 3 WHEN 1 THEN 'PASS' WHEN 2 THEN 'FAIL' END, false FROM c
UNION ALL SELECT k, 'taxable_turnover', 'VAL_104', CASE k % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARNING' WHEN 3 THEN 'PASS' END, false FROM c
UNION ALL SELECT k, 'total_tax_liability', 'VAL_104', CASE WHEN k % 3 > 0 THEN 'PASS' END, false FROM c)
{RESULT}""")
def gst_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, d, "customer").select(
        k, by_rest(k, "27ABCDE1234F1Z5", "27ABCDE", None).alias("gstin"), F.col("c_name").alias("legal_name"), by_rest(k, "n/a", "Q1", "Q2", "Q3", "Q4").alias("filing_period"), F.lit("GSTR-1").alias("return_type"),
        F.lit("509.25").alias("cgst"), F.lit("Rs. 509.25").alias("sgst"), by_rest(k, None, "₹ 1,018.50", "1,000").alias("total_tax_liability"), by_rest(k, "-5", "abc", None, "₹ 12,000").alias("taxable_turnover"),
    )
    return results(rows, "gstr-3b")


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
SELECT k, 'applicant_name' AS field, 'VAL_301' AS rule_code, 'PASS' AS status, true AS blocks FROM c UNION ALL SELECT k, 'loan_type', 'VAL_301', 'PASS', true FROM c
UNION ALL SELECT k, 'loan_amount_requested', 'VAL_301', 'PASS', true FROM c UNION ALL SELECT k, 'loan_tenure', 'VAL_301', CASE k % 6 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, true FROM c
UNION ALL SELECT k, 'annual_income', 'VAL_301', CASE k % 2 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c UNION ALL SELECT k, 'employment_type', 'VAL_301', CASE k % 3 WHEN 2 THEN 'FAIL' ELSE 'PASS' END, false FROM c
UNION ALL SELECT k, 'loan_amount_requested', 'VAL_104', CASE k % 5 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, true FROM c UNION ALL SELECT k, 'annual_income', 'VAL_104', CASE k % 2 WHEN 1 THEN 'WARNING' END, false FROM c
UNION ALL SELECT k, 'employer_name', 'VAL_202', CASE WHEN k % 3 = 0 THEN CASE k % 2 WHEN 0 THEN 'PASS' ELSE 'FAIL' END END, false FROM c
UNION ALL SELECT k, 'applicant_dob', 'VAL_204', CASE k % 2 WHEN 0 THEN 'PASS' ELSE 'FAIL' END, false FROM c
UNION ALL SELECT k, 'applicant_name', 'VAL_303', CASE k % 4 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c)
{RESULT}""")
def loan_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, d, "customer").select(
        k, by_rest(k, "Al", "Alan", "Alma", "Aldo").alias("applicant_name"), F.lit("home").alias("loan_type"), by_rest(k, "0", "50,000", "1", "2", "3").alias("loan_amount_requested"),
        by_rest(k, "null", "12m", "24m", "6m", "5y", "1y").alias("loan_tenure"), by_rest(k, None, "abc").alias("annual_income"), by_rest(k, " Salaried ", "self-employed", None).alias("employment_type"),
        by_rest(k, "Acme", None).alias("employer_name"), by_rest(k, "1990-05-01", "2030-01-01").alias("applicant_dob"),
    )
    return results(rows, "loan_application")


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
SELECT k, 'full_name' AS field, 'VAL_301' AS rule_code, 'PASS' AS status, true AS blocks FROM c UNION ALL SELECT k, 'email', 'VAL_301', 'PASS', true FROM c
UNION ALL SELECT k, 'current_title', 'VAL_301', 'FAIL', false FROM c UNION ALL SELECT k, 'total_experience_years', 'VAL_301', 'PASS', false FROM c
UNION ALL SELECT k, 'email', 'VAL_203', CASE k % 2 WHEN 0 THEN 'PASS' ELSE 'FAIL' END, false FROM c UNION ALL SELECT k, 'phone', 'VAL_203', CASE k % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END, false FROM c
UNION ALL SELECT k, 'skills', 'VAL_302', CASE k % 5 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c UNION ALL SELECT k, 'full_name', 'VAL_303', CASE k % 3 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c
UNION ALL SELECT k, 'education', 'VAL_303', CASE k % 2 WHEN 0 THEN 'FAIL' ELSE 'PASS' END, false FROM c)
{RESULT}""")
def resume_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, d, "customer").select(
        k, by_rest(k, "Al", "Alan", "Alma").alias("full_name"), by_rest(k, "a.b@example.org", "nope").alias("email"), F.lit("5").alias("total_experience_years"), by_rest(k, "+91 98765-43210", "12", "", None).alias("phone"),
        F.when(k % 5 > 0, F.array(F.lit("sql"))).otherwise(F.array().cast("array<string>")).alias("skills"), by_rest(k, "BSc", "MSc Computing, Leeds").alias("education"),
    )
    return results(rows, "cv")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PASS' END AS status FROM orders")
def invoice_totals(spark: SparkSession, d: str) -> DataFrame:
    """Subtotal and tax add up to the total, to a hundredth; nothing to say where one of the three can't be read."""
    k = F.col("o_orderkey")
    rule = validate.total_rule(F.lit("$1,000.50"), by_rest(k, "10", "12", "9.995", "none"), F.lit("USD 1010.50"))
    return load(spark, d, "orders").select(k, rule["status"].alias("status"))


ITEMS = ["part", "supplier", "quantity"]


@query("""WITH n AS (SELECT l_orderkey, round_even(sum((l_partkey % 2 <> 0)::BIGINT + (l_suppkey % 3 <> 0)::BIGINT + 1)::DOUBLE / (3 * count(*)), 2) AS items FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_orderkey, [CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.4 END::DOUBLE, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 0.95 END::DOUBLE, 0.95::DOUBLE, CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 3 THEN 0.85 ELSE 0.7 END::DOUBLE, coalesce(items, 0.0::DOUBLE)] AS s FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
o AS (SELECT *, round_even(list_sum(s) / 5, 2) AS overall_confidence FROM s)
SELECT o_orderkey, s[5] AS items_confidence, overall_confidence, CASE WHEN overall_confidence >= 0.85 THEN 'FOUND' WHEN overall_confidence >= 0.4 THEN 'LOW_CONFIDENCE' ELSE 'NOT_FOUND' END AS overall_status, len(list_filter(s, lambda x: x >= 0.85)) AS found_count, 5 AS total_count FROM o""")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as extractions: four texts and a list of records, their lines."""
    item = F.struct(F.when(F.col("l_partkey") % 2 != 0, F.col("l_partkey").cast("string")).alias("part"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).otherwise("").alias("supplier"), F.col("l_quantity").cast("string").alias("quantity"))
    lists = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("lines"))
    k = F.col("o_orderkey")
    texts = {
        "contact_email": by_rest(k, "a@b.co", "nope"), "order_date": F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")), "total_amount": F.col("o_totalprice").cast("string"),
        "remark": by_rest(k, "ab", "abc", "abcd", "two words"),
    }
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").join(lists, "o_orderkey", "left")
    scored = rows.select(k, validate.scored_fields(texts, {"lines": validate.nested_confidence(F.col("lines"), ITEMS)}).alias("fields"))
    return scored.select(k, F.element_at("fields", -1)["confidence"].alias("items_confidence"), *validate.overall(F.col("fields")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey END AS id, CASE o_orderkey % 5 WHEN 3 THEN 'sorry, ' || o_orderkey WHEN 4 THEN chr(10) || '{\"id\": ' || o_orderkey END AS raw FROM orders")
def model_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers with and without a fence, and two that are no JSON."""
    k = F.col("o_orderkey")
    good = F.concat(F.lit('{"id": '), k.cast("string"), F.lit("}"))
    fenced = lambda head, body: F.concat(F.lit(head), body, F.lit("\n```\nanything"))
    cut = F.concat(F.lit('{"id": '), k.cast("string"))
    text = F.when(k % 5 == 0, F.concat(F.lit(" \n"), good)).when(k % 5 == 1, fenced("```json\n", good)).when(k % 5 == 2, fenced("```\n", good)).when(k % 5 == 3, F.concat(F.lit("sorry, "), k.cast("string"))).otherwise(F.concat(F.lit("```json\n"), cut, F.lit("```")))
    found = load(spark, d, "orders").select(k, adapters.answer_json(text).alias("answer"))
    return found.select(k, F.try_variant_get("answer.json", "$.id", "long").alias("id"), "answer.raw")
