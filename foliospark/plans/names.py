"""Aliases over the star schema's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import names
from foliospark.plans.registry import query
from foliospark.session import load


@query("WITH m AS (SELECT s_nationkey::BIGINT AS key, lower(s_name) AS n, count(*) AS k FROM supplier GROUP BY ALL) SELECT key, count(*) AS people FROM m GROUP BY key")
def name_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier is mentioned twice, in either case; distinct names have distinct surnames here."""
    s = load(spark, d, "supplier")
    once = s.select(F.col("s_nationkey").cast("long").alias("key"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"))
    twice = once.unionByName(once.select("key", (F.col("place") + 1_000_000).alias("place"), F.upper("name").alias("name")))
    return names.clustered(twice).groupBy("key").agg(F.count("*").alias("people"))


@query("SELECT p_partkey, 'brand=' || p_brand || ',' || 'brand_name=' || p_name AS found FROM part")
def loose_columns(spark: SparkSession, d: str) -> DataFrame:
    record = F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("brand_name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    entries = F.transform(F.map_entries(names.loosely(record, "brand")), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))
    return load(spark, d, "part").select("p_partkey", F.array_join(entries, ",").alias("found"))
