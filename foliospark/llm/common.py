"""What the corpus operators share: scratch tables, typed inputs, bounded Arrow batches, gapless numbers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at once; a single longer text is a batch of its own.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, as doc_id and text; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine (tests) a local one where that is
    unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone when the interpreter ends
        return


def written(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs nothing that was done.

    Its path is added to `into`, for `forget_all` once nothing reads it any more; else it goes when the driver ends."""
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"foliospark-{uuid.uuid4().hex}", name)
    df.write.parquet(path)
    if into is None:
        atexit.register(forget, spark, os.path.dirname(path))
    else:
        into.append(os.path.dirname(path))
    return spark.read.schema(df.schema).parquet(path)


def forget_all(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        forget(spark, paths.pop())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@functools.cache
def _trim():  # noqa: ANN202
    """glibc's call that gives freed memory back, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What a worker has freed goes back to the machine: a worker that waits for its next task keeps no more than it holds."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        size = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, values
        give_back()


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array one after the other, and where each row's start (rows + 1 numbers); nulls are empty."""
    array = pc.fill_null(array, "").cast(pa.large_utf8())
    at = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... for each run of lengths, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, salts: int) -> DataFrame:
    """Adds `name`: 0, 1, ... without gaps within equal keys, with no key in a single task.

    Rows of a key are dealt over `salts` parts by a hash of the order; numbers run within a part, and a part starts where
    the counts of the parts before it end. Only those counts, at most salts for a key, meet in one place."""
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inner = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    return inner.join(base, [*keys, "_part"]).withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")
