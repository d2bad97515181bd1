"""Nested records of declared shapes: an order with its lines as a JSON text, read back by its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import dynamic, reshape
from foliospark.plans.registry import query
from foliospark.session import load

#: Shape of the records: texts, a number, a record, a list of texts, a list of records with dates.
SPEC = [
    {"name": "invoice number", "type": "string"},
    {"name": "invoice_date", "type": "date"},
    {"name": "contact_email", "type": "string"},
    {"name": "total_amount", "type": "number"},
    {"name": "vendor", "type": "object", "properties": [{"name": "name", "type": "string"}, {"name": "city", "type": "string"}]},
    {"name": "tags", "type": "list"},
    {"name": "line_items", "type": "list", "properties": [{"name": n, "type": "string"} for n in ("description", "start_date", "end_date", "duration")]},
]


def texts(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and record, a JSON text, of every order that has lines; parts of it are empty or missing by the key."""
    o, k, n = load(spark, d, "orders"), F.col("o_orderkey"), F.col("l_linenumber")
    stated = F.when(n % 3 == 1, "1M ").when(n % 3 == 2, "9y").otherwise("")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    item = F.struct(F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("line "), n.cast("string"))).alias("description"), day.alias("start_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("end_date"), stated.alias("duration"))
    rows = load(spark, d, "lineitem").join(o, F.col("l_orderkey") == k)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_shipdate", item.alias("item")))), lambda x: x["item"])
    each = rows.groupBy("o_orderkey").agg(lines.alias("line_items"), F.first("o_orderdate").alias("o_orderdate"), F.first("o_orderstatus").alias("o_orderstatus"), F.first("o_orderpriority").alias("o_orderpriority"), F.first("o_totalprice").alias("o_totalprice"))
    record = F.struct(
        F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_number"), F.when(k % 5 == 0, "").otherwise(day).alias("invoice_date"),
        F.when(k % 4 == 0, "a.b@example.org").otherwise("no mail").alias("contact_email"), F.col("o_totalprice").alias("total_amount"),
        F.struct(F.col("o_orderpriority").alias("name"), F.when(k % 3 != 0, "Graz").alias("city")).alias("vendor"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("tags"), "line_items", F.lit("not declared").alias("other"),
    )
    return each.select("o_orderkey", F.to_json(record).alias("record"))


def read(spark: SparkSession, d: str) -> DataFrame:
    df = texts(spark, d).select("o_orderkey", dynamic.parsed(F.col("record"), SPEC).alias("record"))
    return dynamic.verified(df, "record", F.lit("2024-01-01").cast("date"))


def exploded(df: DataFrame) -> DataFrame:
    """o_orderkey and each f of a list of records. The list is a column of its own, since Spark compiles no generator over
    lambdas, and comes by explode_outer, since for explode Spark asks beforehand whether it is empty, and works it out for that."""
    return df.select("o_orderkey", F.explode_outer("f").alias("f")).filter(F.col("f").isNotNull())


LINES = """m AS (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_shipdate) - 1 AS i, greatest(0, (year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN day(e) < day(s) THEN 1 ELSE 0 END) AS k
  FROM (SELECT o_orderkey, l_linenumber, l_shipdate, o_orderdate::DATE AS s, l_shipdate::DATE AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
c AS (SELECT *, CASE WHEN k // 12 = 0 THEN k || 'm' WHEN k % 12 = 0 THEN (k // 12) || 'y' ELSE (k // 12) || 'y ' || (k % 12) || 'm' END AS computed, CASE l_linenumber % 3 WHEN 1 THEN '1M ' WHEN 2 THEN '9y' END AS stated FROM m)"""


@query(f"""WITH {LINES}, k AS (SELECT DISTINCT o_orderkey FROM c)
SELECT o_orderkey, 'line_items[' || i || ']' AS field, 'GENERIC_001' AS rule_code, 'missing: description' AS detail FROM c WHERE l_linenumber % 4 = 0
UNION ALL SELECT o_orderkey, 'line_items[' || i || ']', 'GENERIC_003', 'stated ' || stated || ', computed ' || computed FROM c WHERE replace(lower(trim(stated)), ' ', '') <> replace(computed, ' ', '')
UNION ALL SELECT o_orderkey, 'invoice_date', 'GENERIC_002', 'empty or null' FROM k WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'tags', 'GENERIC_002', 'empty or null' FROM k WHERE o_orderkey % 7 = 0""")
def dynamic_rules(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d)
    found = df.select("o_orderkey", dynamic.findings(df, "record").alias("f"))
    return exploded(found).select("o_orderkey", "f.field", "f.rule_code", "f.detail")


@query(f"""WITH {LINES}, k AS (SELECT o_orderkey, round_even(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0.75 ELSE 1 END)::DOUBLE / count(*), 2) AS lines FROM c GROUP BY o_orderkey),
f AS (SELECT o_orderkey, unnest([{{'field': 'invoice_number', 'confidence': 0.7::DOUBLE}}, {{'field': 'invoice_date', 'confidence': CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 0.95 END}}, {{'field': 'contact_email', 'confidence': CASE WHEN o_orderkey % 4 = 0 THEN 0.95 ELSE 0.4 END}}, {{'field': 'total_amount', 'confidence': 0.95}},
  {{'field': 'vendor', 'confidence': CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1 END}}, {{'field': 'tags', 'confidence': CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 0.9 END}}, {{'field': 'line_items', 'confidence': lines}}], recursive := true) FROM k)
SELECT *, CASE WHEN confidence >= 0.85 THEN 'FOUND' WHEN confidence >= 0.4 THEN 'LOW_CONFIDENCE' ELSE 'NOT_FOUND' END AS status FROM f""")
def dynamic_scores(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d)
    scored = df.select("o_orderkey", dynamic.scores(df, "record").alias("f"))
    return exploded(scored).select("o_orderkey", "f.field", "f.confidence", "f.status")


SIZES = ", ".join(f"('{t}', {len(fields)})" for t, fields in dynamic.TEMPLATES.items())


@query(f"""WITH k AS (SELECT DISTINCT o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderkey, template, CASE WHEN template <> 'invoice' THEN 0 ELSE 2 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END END AS found_count, total_count FROM k, (VALUES {SIZES}) AS t(template, total_count)""")
def template_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much of each template a record fills, whichever it was made for."""
    df = texts(spark, d)
    fields = {f["name"]: f for t in dynamic.TEMPLATES for f in dynamic.template(t)}  # a name has one type in all templates
    df = df.select("o_orderkey", dynamic.parsed(F.col("record"), list(fields.values())).alias("record"))
    kinds = {t: reshape.schema(dynamic.template(t)) for t in dynamic.TEMPLATES}
    counts = [F.struct(F.lit(t).alias("template"), dynamic.found_count(F.col("record"), kind).alias("found_count"), F.lit(len(kind)).alias("total_count")) for t, kind in kinds.items()]
    return df.select("o_orderkey", F.explode(F.array(*counts)).alias("t")).select("o_orderkey", "t.template", "t.found_count", "t.total_count")
