"""Deliveries of events to hooks, and what a log of attempts says about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import outbox
from foliospark.plans.registry import query
from foliospark.session import load

#: Longer than a block of the hash, so that it is hashed first.
LONG = "a secret that is longer than one block of the hash function, which takes 64 bytes: "


def hooks(spark: SparkSession, d: str) -> DataFrame:
    """One hook a nation: some inactive, some without a secret or with a long one, some at private addresses, some asking twice."""
    k = F.col("n_nationkey")
    secret = F.when(k % 4 == 0, None).when(k % 3 == 0, F.concat(F.lit(LONG), k.cast("string"))).otherwise(F.concat(F.lit("é"), k.cast("string")))
    url = F.when(k % 5 == 0, "http://10.1.2.3/in").otherwise(F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example.org/in")))
    events = F.when(k % 2 == 0, F.array(F.lit("click"), F.lit("click"))).otherwise(F.array(F.lit("error"), F.lit("purchase")))
    return load(spark, d, "nation").select(k.alias("hook_id"), url.alias("url"), secret.alias("secret"), (k % 7 != 0).alias("is_active"), events.alias("events"))


PADS = ", ".join(f"({x}, unhex('{bytes(i ^ x for i in range(256)).hex()}'))" for x in (outbox.INNER, outbox.OUTER))


# the SQL looks each byte of a key up in a table of all 256, xor with the pad's byte
@query(f"""WITH h AS (SELECT n_nationkey AS hook_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN '{LONG}' || n_nationkey ELSE 'é' || n_nationkey END AS secret,
  CASE WHEN n_nationkey % 5 = 0 THEN 'address' END AS refused, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['click'] ELSE ['error', 'purchase'] END) AS event FROM nation WHERE n_nationkey % 7 <> 0),
r AS (SELECT *, rpad(CASE WHEN octet_length(encode(secret)) > 64 THEN sha256(secret) ELSE hex(encode(secret)) END, 128, '0') AS digits FROM h),
p(x, t) AS (SELECT x, hex(t) FROM (VALUES {PADS}) AS v(x, t)),
k AS (SELECT r.*, unhex(list_aggregate([substring(i.t, ('0x' || substring(digits, 2 * n + 1, 2))::INT * 2 + 1, 2) for n in range(64)], 'string_agg', '')) AS inner_key,
  unhex(list_aggregate([substring(o.t, ('0x' || substring(digits, 2 * n + 1, 2))::INT * 2 + 1, 2) for n in range(64)], 'string_agg', '')) AS outer_key FROM r, p AS i, p AS o WHERE i.x = {outbox.INNER} AND o.x = {outbox.OUTER}),
b AS (SELECT event_id, event_type, '{{"event":"' || event_type || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","data":"' || replace(props, '"', '\\"') || '"}}' AS body FROM events)
SELECT hook_id, event_id, md5(body) AS body_md5, 'sha256=' || sha256(outer_key || unhex(sha256(inner_key || encode(body)))) AS signature, refused FROM k JOIN b ON event = event_type""")
def signed_deliveries(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("event"), F.col("props").alias("data"))
    return outbox.deliveries(events, hooks(spark, d)).select("hook_id", "event_id", F.md5("body").alias("body_md5"), "signature", "refused")


@query("""WITH l AS (SELECT user_id AS hook_id, ts, event_id, event_type NOT IN ('error', 'signup') AS ok FROM events), s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY hook_id ORDER BY ts DESC, event_id DESC) AS later FROM l)
SELECT hook_id, count(*) FILTER (later = 0) AS fail_count, max(ts) FILTER (ok) AS last_triggered FROM s GROUP BY hook_id""")
def hook_health(spark: SparkSession, d: str) -> DataFrame:
    """Users as hooks whose errors and sign-ups are failed attempts."""
    ok = ~F.col("event_type").isin("error", "signup")
    log = load(spark, d, "events").select(F.col("user_id").alias("hook_id"), "event_id", "ts", F.lit(1).alias("attempt"), F.when(ok, 200).otherwise(500).alias("status"), ok.alias("success"))
    return outbox.health(log)
