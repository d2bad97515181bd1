"""Streaming operators, drained over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import load, scratch
from foliospark.streaming import usage


def events(spark: SparkSession, d: str) -> DataFrame:
    return usage.source(spark, f"{d.rstrip('/')}/events.parquet", 1000)


@query("WITH m AS (SELECT max(ts) AS t FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(sum(value), 6) AS value FROM events GROUP BY ALL) SELECT start, event_type, calls, value FROM w, m WHERE start + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Closed hours only, as the watermark closes them."""
    return usage.drain(usage.windowed(events(spark, d))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def tumbling_usage(spark: SparkSession, d: str) -> DataFrame:
    stamped = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return usage.windowed(stamped).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS calls FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    stamped = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return usage.sessions(stamped).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query()
def stream_rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Six calls a day for each user, by the stateful stream; tests hold it against the plain fold."""
    return usage.drain(usage.limiter(events(spark, d), 86_400.0))


@query("""WITH RECURSIVE s AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT s.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts > s.ts + INTERVAL 1 DAY GROUP BY s.user_id, s.ts)
SELECT e.user_id, event_id, NOT (row_number() OVER (PARTITION BY e.user_id, e.ts ORDER BY event_id) = 1 AND s.ts IS NOT NULL) AS hit FROM events e LEFT JOIN (SELECT DISTINCT user_id, ts FROM s) s USING (user_id, ts)""")
def stream_expiring_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that live for a day, by state that timers take away."""
    return usage.drain(usage.expiring(events(spark, d), 86_400.0))


CHANGED = "purchase"


@query(f"""WITH e AS (SELECT *, user_id || '|' || event_type AS key, user_id AS document FROM events),
g AS (SELECT document, max((ts, event_id)) AS gone FROM e WHERE event_type = '{CHANGED}' GROUP BY document),
c AS (SELECT e.* FROM e LEFT JOIN g USING (document) WHERE event_type <> '{CHANGED}' AND (gone IS NULL OR (ts, event_id) > gone))
SELECT key, document, arg_min(value, (ts, event_id)) AS answer, min(ts) AS set_at, count(*) - 1 AS hits FROM c GROUP BY key, document""")
def response_cache_table(spark: SparkSession, d: str) -> DataFrame:
    """The cache as a table that the stream of calls keeps, where some events take a document's entries away."""
    path = scratch(spark, "responses")
    read = events(spark, d).select("event_id", "ts", F.col("event_type").alias("kind"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("user_id").alias("document"), F.col("value").alias("answer"))
    usage.response_cache(read, path, CHANGED)
    return usage.current(spark, path).withColumn("set_at", F.col("set_at").cast("timestamp_ntz"))


@query()
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    return usage.limiter_batch(load(spark, d, "events"), 86_400.0)
