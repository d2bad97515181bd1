"""Events for outside receivers: fan-out to hooks, signatures, attempts, and what a log says about each hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.markup import refusal

#: How often a delivery is tried.
ATTEMPTS = 3
# Block of SHA-256 in bytes, and the bytes of the inner and the outer pad.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
LOG = "hook_id long, event_id long, ts timestamp, attempt int, status int, success boolean"
#: (url, body, headers) to an HTTP status; an error counts as status 0.
Send = Callable[[str, str, dict], int]


def pads(secret: Column) -> list[Column]:
    """inner and outer: the two padded keys of HMAC-SHA256, as bytes; null for a null or empty secret."""
    raw = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(raw) > BLOCK, F.sha2(raw, 256)).otherwise(F.hex(raw))
    digits = F.rpad(key, BLOCK * 2, "0")

    def padded(byte: int) -> Column:
        one = lambda i: F.lpad(F.hex(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0")
        return F.when(secret != "", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), one), "")))

    return [padded(INNER).alias("inner"), padded(OUTER).alias("outer")]


def signature(body: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 of a text as lowercase hex, from the padded keys."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def deliveries(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """hook_id, url, event_id, ts, event, body, signature, refused: each event once for every active hook that asks for it.

    events(event_id, ts, event, data), hooks(hook_id, url, secret, is_active, events array). Keys are padded once a hook;
    the join is on the event's name, and a name asked for twice counts once. A body is JSON of event, timestamp and data. A
    hook without a secret has no signature; refused says why an address may not be called, null where it may. Events without
    a name and hooks that ask for none have no deliveries.
    """
    asked = hooks.filter("is_active").select("hook_id", "url", *pads(F.col("secret")), refusal(F.col("url")).alias("refused"), F.explode(F.array_distinct("events")).alias("event"))
    body = F.to_json(F.struct("event", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "data"))
    signed = events.select("event_id", "ts", "event", body.alias("body")).join(asked, "event")
    return signed.select("hook_id", "url", "event_id", "ts", "event", "body", F.concat(F.lit("sha256="), signature(F.col("body"), F.col("inner"), F.col("outer"))).alias("signature"), "refused")


def attempted(sends: DataFrame, send: Send, prefix: str = "X-Hook") -> DataFrame:
    """One row of LOG for each attempt: up to ATTEMPTS until a status below 400. Refused addresses are never called and have
    one failed row of status 0. Write the result once and read it: each action sends again."""

    def tries(row) -> Iterator[tuple]:  # noqa: ANN001
        headers = {"Content-Type": "application/json", f"{prefix}-Event": row.event}
        if row.signature is not None:
            headers[f"{prefix}-Signature"] = row.signature
        for n in range(1, (1 if row.refused is not None else ATTEMPTS) + 1):
            try:
                status = 0 if row.refused is not None else int(send(row.url, row.body, headers))
            except Exception:  # noqa: BLE001 - whatever a receiver does is a failed attempt
                status = 0
            yield row.hook_id, row.event_id, row.ts, n, status, 0 < status < 400
            if 0 < status < 400:
                return

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype({"signature": object, "refused": object}).where(b.notna(), None)
            yield pd.DataFrame([t for row in b.itertuples(index=False) for t in tries(row)], columns=["hook_id", "event_id", "ts", "attempt", "status", "success"])

    return sends.select("hook_id", "url", "event_id", "ts", "event", "body", "signature", "refused").mapInPandas(work, LOG)


def health(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """hook_id, fail_count, last_triggered: failed attempts since the last success, and when that was (its event's time; null if
    never). Attempts count in the order of time, event and attempt. before: the same columns from earlier attempts. Two
    aggregates with partial sums, so a hook with most of the rows is no single task."""
    order = F.struct("ts", "event_id", "attempt")
    last = log.filter("success").groupBy("hook_id").agg(F.max(order).alias("last"))
    rows = log.select("hook_id", "success", order.alias("at")).join(last, "hook_id", "left")
    now = rows.groupBy("hook_id").agg(F.count_if(~F.col("success") & (F.col("last").isNull() | (F.col("at") > F.col("last")))).alias("fails"), F.max("last.ts").alias("good"))
    if before is None:
        return now.select("hook_id", F.col("fails").alias("fail_count"), F.col("good").alias("last_triggered"))
    both = before.join(now, "hook_id", "full")
    old = F.when(F.col("good").isNull(), F.coalesce("fail_count", F.lit(0))).otherwise(0)
    return both.select("hook_id", (F.coalesce("fails", F.lit(0)) + old).alias("fail_count"), F.coalesce("good", "last_triggered").alias("last_triggered"))
