"""Chunks as column functions against the plain function."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions.sentences import chunks, family
from foliospark.operators import chunk
from foliospark.operators.chunk import hierarchy, split
from foliospark.session import load


@pytest.mark.parametrize(("size", "overlap", "unit"), [(8, 3, "token"), (5, 0, "token"), (40, 12, "char"), (7, 7, "char")])
def test_drawn_texts(spark, size, overlap, unit):
    rng = random.Random(size)
    texts = ["", "  \n ", "one", "a" * 100, "w " * 50] + ["".join(rng.choice(["word ", "é\U0001f600 ", "End. ", "What?\n", "x! ", "\n\n", "longer", ".", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks(F.col("t"), size, overlap, unit).alias("c")).collect()
    for r in rows:
        assert r.c == split(r.t, size, overlap, unit), r.t


def test_whole_table(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("text", chunks(F.col("text")).alias("c"), chunks(F.col("text"), 400, 50, "char").alias("d")).collect()
    for r in rows:
        assert r.c == split(r.text) and r.d == split(r.text, 400, 50, "char")


def test_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(chunks(F.col("t")).alias("c")).collect()[0].c is None


@pytest.mark.parametrize(("parent", "child"), [(60, 12), (20, 20)])
def test_parents(spark, sf_dir, parent, child):
    rows = load(spark, sf_dir, "documents").select("text", family(F.col("text"), parent, child).alias("f")).collect()
    for r in rows:
        assert [tuple(x) for x in r.f] == hierarchy(r.text, parent, child)


def test_sizes_are_added_up(spark, monkeypatch):
    """A piece is measured a fixed number of times, not again with each that follows in its run."""
    plan = spark.range(1).select(chunks(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2  # the fold over pieces, and the tail of a run that is closed
    seen = []
    whole = chunk.measured
    monkeypatch.setattr(chunk, "measured", lambda t, unit: seen.append(len(t)) or whole(t, unit))
    text = "\n".join(["some words"] * 3000)
    assert len(split(text)) > 1
    assert sum(seen) <= 3 * len(text)
