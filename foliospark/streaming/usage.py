"""Structured Streaming over the events log: windows, sessions, a rate limiter, expiring entries, a cache, and a sink that upserts.

A source is a folder of Parquet files; `drain` runs a query to the end of what is there, in order of files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from foliospark.session import dropped, scratch

WINDOW, LATE, GAP = "1 hour", "10 minutes", "30 minutes"
SPAN, LIMIT = 60, 6


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of a Parquet folder or file, its ts as an instant."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = WINDOW, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Calls and value by window and type; a window closes when the watermark has passed it."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    done = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 6).alias("value"))
    return done.select(F.col("w.start").alias("start"), "event_type", "calls", "value")


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Calls by session of a user: a session ends with a gap."""
    done = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return done.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "calls")


def limited(times: list[float], held: list[float], span: float = SPAN, limit: int = LIMIT) -> tuple[list[bool], list[float]]:
    """Which calls pass, in order of time: those with fewer than `limit` passed calls in the `span` before. A refused call
    isn't held against later ones."""
    passed = []
    for t in times:
        held = [h for h in held if h > t - span]
        passed.append(len(held) < limit)
        if passed[-1]:
            held.append(t)
    return passed, held


DECISIONS = "user_id long, event_id long, allowed boolean"
HITS = "user_id long, event_id long, hit boolean"
#: Timers, and state with a time to live, are with this store only.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Timed(StatefulProcessor):
    """A fold of a user's calls in order of time whose state goes when the watermark passes its end.

    Calls of a batch are taken by time and id; those of a later batch that are older but not behind the watermark are held
    against the state as it is by then. What is behind the watermark that the batch before began with doesn't come here."""

    def __init__(self, span: float, column: str) -> None:
        self.span, self.column = span, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held array<double>")

    def step(self, times: list[float], held: list[float]) -> tuple[list[bool], list[float]]:
        raise NotImplementedError

    def end(self, held: list[float]) -> float:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = [float(x) for x in self.state.get()[0]] if self.state.exists() else []
        found, held = self.step([t.timestamp() for t in calls["ts"]], held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.state.update((held,))
            self.handle.registerTimer(int(self.end(held) * 1000) + 1)
        else:
            self.state.clear()
        yield pd.DataFrame({"user_id": key[0], "event_id": calls["event_id"].to_numpy(), self.column: found})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Limiter(Timed):
    """State: the passed calls of a user within the span."""

    def __init__(self, span: float, limit: int) -> None:
        super().__init__(span, "allowed")
        self.limit = limit

    def step(self, times: list[float], held: list[float]) -> tuple[list[bool], list[float]]:
        return limited(times, held, self.span, self.limit)

    def end(self, held: list[float]) -> float:
        return max(held) + self.span


class Entry(Timed):
    """State: the instant at which a user's entry was set, if it is still alive."""

    def __init__(self, span: float) -> None:
        super().__init__(span, "hit")

    def step(self, times: list[float], held: list[float]) -> tuple[list[bool], list[float]]:
        hits = []
        for t in times:
            hits.append(bool(held) and t <= held[0] + self.span)
            if not hits[-1]:
                held = [t]
        return hits, held

    def end(self, held: list[float]) -> float:
        return held[0] + self.span


def folded(events: DataFrame, processor: Timed, schema: str, late: str) -> DataFrame:
    read = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return read.groupBy("user_id").transformWithStateInPandas(processor, schema, "append", "eventTime")


def limiter(events: DataFrame, span: float = SPAN, limit: int = LIMIT, late: str = LATE) -> DataFrame:
    """The sliding-window limiter as a stateful stream. A user's state is gone once the watermark is past the span of the
    last call that passed; a user who has been idle costs nothing."""
    return folded(events, Limiter(span, limit), DECISIONS, late)


def expiring(events: DataFrame, span: float, late: str = LATE) -> DataFrame:
    """hit: whether a user's entry, which a miss sets for `span` seconds and a hit doesn't renew, answers a call."""
    return folded(events, Entry(span), HITS, late)


def limiter_batch(events: DataFrame, span: float = SPAN, limit: int = LIMIT) -> DataFrame:
    """The same decisions over a table."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        passed, _ = limited([t.timestamp() for t in rows["ts"]], [], span, limit)
        return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "allowed": passed})

    return events.groupBy("user_id").applyInPandas(step, DECISIONS)


def started(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Runs a query over what its source holds now, its state in the store that has timers."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


def drain(stream: DataFrame) -> DataFrame:
    """All that the stream gives for what its source holds now, as a table in the shared folder, with its checkpoint there."""
    spark = stream.sparkSession
    path = scratch(spark, "drained")
    started(stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint"), spark)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last whole version of a table of versions, under a number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    whole = [n for n in (int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))]
    return max((n for n in whole if below is None or n < below), default=None)


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version(spark, path)}")


def kept_versions(stream: DataFrame, path: str, merge: Callable[..., DataFrame], numbered: bool = False) -> None:
    """A table that each batch replaces by merge(batch, table before it), if numbered with the batch's number behind. A batch's number names its version, made from the
    last whole one under that number, so that a batch that comes again writes the same rows; the checkpoint beside it makes
    numbers go on after a restart. Of older versions the last two stay."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        last = version(batch.sparkSession, path, n)
        old = None if last is None else batch.sparkSession.read.parquet(f"{path}/v{last}")
        merge(batch, old, *([n] if numbered else [])).write.mode("overwrite").parquet(f"{path}/v{n}")
        if last is not None and (older := version(batch.sparkSession, path, last)) is not None and (oldest := version(batch.sparkSession, path, older)) is not None:
            dropped(spark, f"{path}/v{oldest}")

    started(stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint"), spark)


def upserted(stream: DataFrame, key: str, path: str) -> None:
    """Keeps the latest row of each key in a Parquet folder, one version a batch."""

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        every = batch if old is None else old.select(*batch.columns).unionByName(batch)
        return every.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")

    kept_versions(stream, path, merge)


def response_cache(stream: DataFrame, path: str, changed: str) -> None:
    """The cache of answers as a table: key, document, answer, set_at, hits.

    stream(event_id, ts, kind, key, document, answer): a call sets its entry if there is none and counts as a hit if there
    is; an event of the kind `changed` takes away its document's entries that were set before it, so that the next call sets
    a new one. Events count in order of time and id within a batch, and batches in their order; one entry's later history
    doesn't depend on hits, so each entry is the first call after its document's last change."""

    def merge(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        at = F.struct("ts", "event_id")
        gone = batch.filter(F.col("kind") == changed).groupBy("document").agg(F.max(at).alias("gone"))
        calls = batch.filter(F.col("kind") != changed).join(gone, "document", "left").filter(F.col("gone").isNull() | (at > F.col("gone")))
        fresh = calls.groupBy("key").agg(F.min_by(F.struct("document", "answer", "ts", "event_id"), at).alias("x"), F.count("*").alias("n")).select("key", "x.*", F.col("ts").alias("set_at"), "n")
        fresh = fresh.select("key", "document", "answer", "set_at", "n")
        if old is None:
            return fresh.select("key", "document", "answer", "set_at", (F.col("n") - 1).alias("hits"))
        alive = old.join(gone, "document", "left").filter(F.col("gone").isNull()).drop("gone")
        both = alive.join(fresh.select("key", F.struct("document", "answer", "set_at").alias("new"), "n"), "key", "full")
        is_old = F.col("document").isNotNull()
        pick = lambda c: F.when(is_old, F.col(c)).otherwise(F.col(f"new.{c}")).alias(c)
        hits = F.when(is_old, F.col("hits") + F.coalesce("n", F.lit(0))).otherwise(F.col("n") - 1).alias("hits")
        return both.select("key", pick("document"), pick("answer"), pick("set_at"), hits)

    kept_versions(stream, path, merge)
