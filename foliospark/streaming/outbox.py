"""The outbox as a stream: each batch of events is sent once, logged, and counted for each hook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import outbox
from foliospark.streaming.usage import kept_versions, version


def run(events: DataFrame, hooks: DataFrame, send: outbox.Send, path: str) -> None:
    """Sends what the stream of events holds now. path/log/v<n>: attempts of batch n; path/state: fail_count and last_triggered
    of each hook, a version a batch. A batch that comes again after its log was whole isn't sent again, but counted from the
    log; one that broke off before is sent as a whole. Receivers may thus see an event twice, the log has it once."""

    def merge(batch: DataFrame, before: DataFrame | None, n: int) -> DataFrame:
        spark = batch.sparkSession
        place = f"{path}/log"
        if version(spark, place, n + 1) != n:
            outbox.attempted(outbox.deliveries(batch, hooks), send).write.mode("overwrite").parquet(f"{place}/v{n}")
        return outbox.health(spark.read.schema(outbox.LOG).parquet(f"{place}/v{n}"), before)

    kept_versions(events, f"{path}/state", merge, numbered=True)


def log(spark, path: str) -> DataFrame:  # noqa: ANN001
    """All attempts, with their batch."""
    rows = spark.read.schema(outbox.LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/v(\d+)/", 1).cast("long"))
