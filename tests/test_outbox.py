"""Signatures, attempts and the outbox over batches."""

import hashlib
import hmac
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliospark.operators import outbox
from foliospark.streaming import outbox as stream

DAY = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, event string, data string"
HOOKS = "hook_id long, url string, secret string, is_active boolean, events array<string>"


def test_signatures_equal_the_standard_library(spark):
    secrets = ["k", "é" * 31, "x" * 63, "x" * 64, "x" * 65, "ü" * 400, "\x00\x01"]
    rows = [(s, b) for s in secrets for b in ("", "body ü\n", "z" * 10000)]
    df = spark.createDataFrame(rows, "s string, b string").select("s", "b", *outbox.pads(F.col("s")))
    for r in df.select("s", "b", outbox.signature(F.col("b"), F.col("inner"), F.col("outer")).alias("g")).collect():
        assert r.g == hmac.new(r.s.encode(), r.b.encode(), hashlib.sha256).hexdigest()
    none = spark.createDataFrame([(None,), ("",)], "s string").select(*outbox.pads(F.col("s"))).collect()
    assert all(r.inner is None and r.outer is None for r in none)


def test_each_hook_once(spark):
    events = spark.createDataFrame([(1, DAY, "a", None), (2, DAY, None, "x"), (3, DAY, "b", "x")], EVENTS)
    hooks = spark.createDataFrame([(1, "https://h.org", "s", True, ["a", "a", "b"]), (2, "https://h.org", "s", False, ["a"]), (3, "ftp://h.org", None, True, ["a"]), (4, None, None, True, None), (5, "https://h.org", None, True, [])], HOOKS)
    got = sorted((r.hook_id, r.event_id, r.signature is None, r.refused) for r in outbox.deliveries(events, hooks).collect())
    assert got == [(1, 1, False, None), (1, 3, False, None), (3, 1, True, "scheme")]


def sender(folder):
    """Answers by the address, and writes down each call."""

    def send(url, body, headers):
        with open(os.path.join(folder, hashlib.md5((url + body).encode()).hexdigest()), "a") as f:
            f.write(".")
        tries = os.path.getsize(f.name)
        if "down" in url:
            raise OSError("no route")
        return 503 if "slow" in url and tries < 3 else 404 if "gone" in url else 204

    return send


def test_attempts_and_replay(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    hooks = spark.createDataFrame([(i, f"{u}/in", "s" if i % 2 else None, True, ["a"]) for i, u in enumerate(["https://ok.org", "https://slow.org", "https://gone.org", "https://down.org", "http://127.0.0.1"])], HOOKS)
    calls = lambda: sum(f.stat().st_size for f in (tmp_path / "calls").iterdir())

    def batch(ids):
        rows = [(i, DAY + timedelta(hours=i), "a", f"d{i}") for i in ids]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream.run(spark.readStream.schema(EVENTS).parquet(source), hooks, sender(str(tmp_path / "calls")), path)

    def health():
        from foliospark.streaming.usage import current

        return {r.hook_id: (r.fail_count, r.last_triggered) for r in current(spark, f"{path}/state").collect()}

    batch([1, 2])
    assert calls() == 2 * (1 + 3 + 3 + 3)
    assert health() == {0: (0, DAY + timedelta(hours=2)), 1: (0, DAY + timedelta(hours=2)), 2: (6, None), 3: (6, None), 4: (2, None)}
    batch([3])
    assert calls() == 3 * 10
    assert health() == {0: (0, DAY + timedelta(hours=3)), 1: (0, DAY + timedelta(hours=3)), 2: (9, None), 3: (9, None), 4: (3, None)}
    log = stream.log(spark, path)
    assert {r.batch: r["count"] for r in log.groupBy("batch").count().collect()} == {0: 2 * 11, 1: 11}
    # a batch whose commit was lost comes again: neither sent nor counted twice
    for name in ("1", ".1.crc"):
        os.remove(f"{path}/state/checkpoint/commits/{name}")
    stream.run(spark.readStream.schema(EVENTS).parquet(source), hooks, sender(str(tmp_path / "calls")), path)
    assert calls() == 3 * 10 and health()[2] == (9, None) and stream.log(spark, path).count() == 33
