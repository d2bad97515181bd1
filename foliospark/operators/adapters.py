"""Models outside: replaceable providers, a cache before them, and stages that keep what each gave.

A provider turns a batch of prompts into answers. Rows that the cache answers never reach it: the cache is a table, joined
by the digest of all that makes an answer, and new answers are appended to it."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.strings import prompt_hash, stripped
from foliospark.session import written

ATTEMPTS, FIRST_WAIT = 3, 2.0
RESULT_KEYS = ["summary", "findings", "data", "extra"]


class Provider(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class Deterministic:
    """Stands in for a model: the same prompt gives the same short answer."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [hashlib.sha256(p.encode()).hexdigest()[:12] for p in prompts]


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """Stands in for an embedder: words hashed to signed buckets, of unit length."""
    v = [0.0] * size
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def rate_limited(error: Exception) -> bool:
    """Whether a provider says that it was asked too often; nothing else is worth a second try."""
    said = str(error).lower()
    return "rate limit" in said or "429" in said


def answered(prompts: DataFrame, provider: Provider, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> DataFrame:
    """key, answer, error: a batch that is refused for its rate is tried again, after a wait that doubles; what fails for
    another reason, or still fails, becomes an error and no exception. prompts(key, prompt)."""

    def run(batches: Iterator) -> Iterator:  # noqa: ANN401
        import pandas as pd

        for b in batches:
            for turn in range(attempts):
                try:
                    out, error = provider.answer(list(b["prompt"])), None
                    break
                except Exception as e:  # noqa: BLE001 - whatever a provider raises is its rows' error
                    out, error = [None] * len(b), str(e)
                    if not rate_limited(e) or turn == attempts - 1:
                        break
                    time.sleep(wait * 2**turn)
            yield pd.DataFrame({"key": b["key"], "answer": out, "error": [error] * len(b)})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")


def through_cache(calls: DataFrame, cache: DataFrame, provider: Provider, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers of calls(id, user, model, system, text), with hit; and the new rows of the cache(key, answer).

    name is the provider's, and part of the key: answers of one are none of another's. Each missing prompt goes to the
    provider once, however often it is asked and whatever is read of the results: its answers are a table."""
    parts = [F.col("user"), *([F.lit(name)] if name else []), F.col("model"), F.col("system"), F.col("text")]
    keyed = calls.withColumn("key", prompt_hash(*parts))
    known = cache.select("key", "answer")
    missing = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min("text").alias("prompt"))
    fresh = written(answered(missing, provider), "answers")
    every = known.withColumn("hit", F.lit(True)).unionByName(fresh.select("key", "answer", F.lit(False).alias("hit")))
    return keyed.join(every, "key", "left").select("id", "key", "answer", "hit"), fresh.filter("error is null").select("key", "answer")


def complete(result: Column) -> Column:
    """A result map has all that it must."""
    return F.size(F.array_except(F.array(*map(F.lit, RESULT_KEYS)), F.map_keys(result))) == 0


def staged(spark: SparkSession, start: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str) -> DataFrame:
    """Stages in turn, each written to the folder; a rerun goes on after the last one that was finished."""
    df = start
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for i, (name, stage) in enumerate(stages):
        path = os.path.join(folder, f"{i:02d}-{name}")
        done = hadoop(os.path.join(path, "_SUCCESS"))
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def answer_json(text: Column) -> Column:
    """json (a variant) of a model's answer, with or without a fence around it; raw holds what couldn't be parsed, else
    null. What follows a closing fence doesn't count."""
    whole = stripped(text)
    inside = F.regexp_replace(F.get(F.split(whole, "```"), F.lit(1)), "^json", "")
    body = F.when(whole.startswith("```"), inside).otherwise(whole)
    json = F.try_parse_json(stripped(body))
    return F.struct(json.alias("json"), F.when(json.isNull(), body).alias("raw"))
