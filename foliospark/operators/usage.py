"""Usage, cost, quota, cache and lineage accounting over call logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calls whose answers may be cached.
CACHEABLE = ["expand", "evidence_extract", "extract", "extract_tables", "summarize", "nl_to_schema", "classify_document", "hyde", "multiquery", "split_detection", "vision"]


def summary(calls: DataFrame, *keys: str) -> DataFrame:
    """Counts, tokens, cost, latency and hit rate by keys. calls(..., tokens, cost, latency, cache_hit), nulls count 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum(zero("tokens")).alias("tokens"), F.round(F.sum(zero("cost")), 6).alias("cost"),
        F.round(F.avg("latency"), 1).alias("avg_latency"), F.round(F.avg(F.col("cache_hit").cast("int")), 4).alias("hit_rate"),
    )


def session(calls: DataFrame, key: str) -> DataFrame:
    """By key, and by key and call_type: calls, tokens (a quarter of the code points of a call, rounded down), avg_latency_ms
    (of whole milliseconds, ties to the even one), is_total. calls(key, call_type, prompt_chars, response_chars, latency in
    seconds); null sizes count 0, null latencies don't count, and a null call_type is a type."""
    chars = F.coalesce("prompt_chars", F.lit(0)) + F.coalesce("response_chars", F.lit(0))
    one = calls.select(F.col(key), "call_type", F.floor(chars / 4).alias("_tokens"), F.bround(F.col("latency") * 1000).alias("_ms"))
    sets = one.groupingSets([[F.col(key), F.col("call_type")], [F.col(key)]], F.col(key), F.col("call_type"))
    out = sets.agg(F.count("*").alias("calls"), F.sum("_tokens").alias("tokens"), F.bround(F.avg("_ms")).cast("long").alias("avg_latency_ms"), F.grouping("call_type").cast("boolean").alias("is_total"))
    return out.select(key, "call_type", "calls", "tokens", "avg_latency_ms", "is_total")


def counters(documents: DataFrame, lineage: DataFrame, calls: DataFrame, day: Column) -> DataFrame:
    """user_id, documents, uploads_today, cost_month, queries_today as of a day (UTC), for users who have any of these rows:
    what quotas are held against. documents(user_id), lineage(user_id, event_type, ts), calls(user_id, call_type, cost, ts).
    What is dated later counts too; rows without an instant don't, nor do null costs. Counts meet in one shuffle, after sums
    in the tasks; rows of a null user are one user."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    today, month = F.col("ts") >= day.cast("timestamp"), F.col("ts") >= F.trunc(day, "MM").cast("timestamp")
    row = lambda df, d=zero, u=zero, c=F.lit(0.0), q=zero: df.select("user_id", d.alias("documents"), u.alias("uploads_today"), c.alias("cost_month"), q.alias("queries_today"))
    uploads = row(lineage.filter((F.col("event_type") == "upload_received") & today), u=one)
    asked = row(calls.filter(month), c=F.coalesce("cost", F.lit(0.0)), q=F.when((F.col("call_type") == "query") & today, one).otherwise(zero))
    every = row(documents, d=one).unionByName(uploads).unionByName(asked)
    return every.groupBy("user_id").agg(F.sum("documents").alias("documents"), F.sum("uploads_today").alias("uploads_today"), F.round(F.sum("cost_month"), 6).alias("cost_month"), F.sum("queries_today").alias("queries_today"))


def daily(calls: DataFrame) -> DataFrame:
    """user_id, day, queries, extractions, calls, cost, hits."""
    return calls.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("call_type") == "view").alias("queries"), F.count_if(F.col("call_type") == "click").alias("extractions"),
        F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.count_if("cache_hit").alias("hits"),
    )


def monthly(calls: DataFrame, *levels: str) -> DataFrame:
    """Roll-up by month and levels, in one pass: a null level is a total. Calls from the cache aren't billed."""
    month = F.trunc(F.to_date("ts"), "MM").alias("month")
    rolled = calls.select(month, "*").rollup("month", *levels).agg(
        F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum(F.when(~F.col("cache_hit"), F.col("cost")).otherwise(0.0)), 6).alias("billable"), F.count_distinct("user_id").alias("members"),
    )
    return rolled.filter(F.col("month").isNotNull())


def resolved_quota(users: DataFrame, quotas: DataFrame) -> DataFrame:
    """The most specific quota of each user: own, team's, organisation's, default. users(user_id, team_id, org_id),
    quotas(scope, scope_id, quota_limit)."""
    out = users
    for scope, key in (("user", "user_id"), ("team", "team_id"), ("org", "org_id")):
        own = quotas.filter(F.col("scope") == scope).select(F.col("scope_id").alias(key), F.col("quota_limit").alias(f"{scope}_limit"))
        out = out.join(own, key, "left")
    base = quotas.filter("scope = 'default'").agg(F.max("quota_limit").alias("default_limit"))
    return out.crossJoin(F.broadcast(base)).withColumn("quota_limit", F.coalesce("user_limit", "team_limit", "org_limit", "default_limit"))


def status(used: Column, limit: Column) -> Column:
    """used, limit, exceeded, per cent used."""
    return F.struct(used.alias("used"), limit.alias("quota_limit"), (used >= limit).alias("exceeded"), F.when(limit > 0, F.round(used / limit * 100, 1)).otherwise(0.0).alias("pct_used"))


def cached_calls(calls: DataFrame, key: str) -> DataFrame:
    """hit: an earlier call of the key answers."""
    return calls.withColumn("hit", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")) > 1)


def expiring_calls(calls: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """key, event_id, hit of calls(key, ts, event_id): an entry is set by a miss and lives for ttl_seconds from then on,
    the last instant included; a hit doesn't renew it.

    Calls of a key come sorted through one task, which holds a batch and the instant at which the entry ends, and leaps from
    miss to miss. Calls without an instant miss and set nothing; null keys are one key."""
    ttl = round(ttl_seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ends = None, None
        for b in batches:
            names, at = b.column("_name"), b.column("_at").cast(pa.int64())
            hit = np.zeros(b.num_rows, bool)
            runs = pc.run_end_encode(names)
            start = 0
            for value, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if value != name:
                    name, ends = value, None
                part = at.slice(start, stop - start)
                i = start + part.null_count  # nulls come first
                times = at.slice(i, stop - i).to_numpy(zero_copy_only=False)
                j = 0
                while j < len(times):
                    until = j if ends is None else int(np.searchsorted(times, ends, side="right"))
                    hit[i + j : i + until] = True
                    j = max(j, until)
                    if j < len(times):
                        ends, j = times[j] + ttl, j + 1
                start = stop
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("event_id"), pa.array(hit)], [key, "event_id", "hit"])

    dealt = calls.select(key, "event_id", F.to_json(F.struct(F.col(key))).alias("_name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    kinds = dict(calls.select(key, "event_id").dtypes)
    return dealt.repartition("_name").sortWithinPartitions("_name", "_at", "event_id").mapInArrow(run, f"`{key}` {kinds[key]}, event_id {kinds['event_id']}, hit boolean")
