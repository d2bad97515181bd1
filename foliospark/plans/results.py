"""Runs of rows as merged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import load
from foliospark.sources import results

RUNS = """c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND event_id > min(event_id) OVER (PARTITION BY user_id) THEN 0 ELSE 1 END AS change FROM events),
r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY user_id, block) AS n FROM r)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return results.spans(load(spark, d, "events"), "user_id", "event_type", "event_id")


@query(f"WITH {RUNS} SELECT user_id, event_id, CASE WHEN change = 1 THEN n ELSE 0 END AS rowspan FROM s")
def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("user_id", "event_id", "rowspan")


@query(f"""WITH {RUNS}, m AS (SELECT coalesce(bool_or(change = 0 AND props IS NOT NULL), false) AS p, coalesce(bool_or(change = 0 AND value > 100), false) AS v FROM s)
SELECT unnest(['props', 'high', 'first']) AS "column", unnest([NOT p, NOT v, true]) AS mergeable FROM m""")
def mergeable_columns(spark: SparkSession, d: str) -> DataFrame:
    """Texts of every row, values above 100, and values of first rows only."""
    df = runs(spark, d).withColumn("high", F.when(F.col("value") > 100, F.col("value"))).withColumn("first", F.when(F.col("place") == 1, F.col("value")))
    return results.mergeable(df, ["props", "high", "first"])
