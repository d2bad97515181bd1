"""Places of many values in many texts, in one pass: an automaton over the values finds all of them at once in each text.

Values come in blocks of at most CHARACTERS, one automaton each; a text is read once a block, whatever the number of its
values. No text is held against a single value, and what leaves a task is one row for each value that a text holds."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.strings import stripped

#: Code points of the values of one automaton, and of the shortest value that is looked for.
CHARACTERS, SHORTEST = 1 << 21, 4


@functools.lru_cache(maxsize=1)
def automaton(values: tuple[str, ...]) -> ahocorasick.Automaton:
    """One for all tasks of a worker."""
    made = ahocorasick.Automaton()
    for i, value in enumerate(values):
        made.add_word(value, (i, len(value)))
    made.make_automaton()
    return made


def blocks(values: DataFrame, most: int = CHARACTERS) -> Iterator[list[str]]:
    """Distinct values in blocks, one at a time on the driver; a longer value is a block of its own."""
    held, size = [], 0
    for row in values.select("value").distinct().toLocalIterator():
        if held and size + len(row["value"]) > most:
            yield held
            held, size = [], 0
        held.append(row["value"])
        size += len(row["value"])
    if held:
        yield held


def found(texts: DataFrame, content: str, values: Broadcast) -> DataFrame:
    """texts with value and at (from 0), a row for each value that a text holds: its first place. The content goes."""
    columns = [c for c in texts.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = values.value
        search = automaton(known)
        for b in batches:
            row, value, at = [], [], []
            for i, text in enumerate(b.column(content).to_pylist()):
                first: dict[int, int] = {}
                for end, (k, n) in search.iter(text or ""):
                    first.setdefault(k, end - n + 1)
                row += [i] * len(first)
                value += [known[k] for k in first]
                at += first.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in columns), pa.array(value, pa.string()), pa.array(at, pa.int64())], [*columns, "value", "at"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "value string", "at long"]))


def places(chunks: DataFrame, values: DataFrame, most: int = CHARACTERS) -> DataFrame:
    """value_id, doc_id, chunk_id, at, bbox: where each value stands first in each document that has it.

    chunks(doc_id, chunk_id, content, bbox), values(value_id, value). Case and outer white space don't count; values of under
    SHORTEST code points, and chunks without a place on a page (null bbox), are passed over. Of a document's chunks that
    hold the value the one counts in which it stands earliest, the first of equals. Equal values are found once and belong to
    all their ids; empty tables give no rows."""
    spark = chunks.sparkSession
    wanted = values.select("value_id", F.lower(stripped(F.col("value"))).alias("value")).filter(F.length("value") >= SHORTEST)
    texts = chunks.filter("bbox is not null").select("doc_id", "chunk_id", "bbox", F.lower("content").alias("content"))
    out = None
    for block in blocks(wanted, most):
        sent = spark.sparkContext.broadcast(tuple(block))  # at most CHARACTERS, or a single value
        hits = found(texts, "content", sent)
        first = hits.groupBy("value", "doc_id").agg(F.min_by(F.struct("chunk_id", "at", "bbox"), F.struct("at", "chunk_id")).alias("x")).select("value", "doc_id", "x.*")
        out = first if out is None else out.unionByName(first)
    if out is None:
        out = texts.select(F.col("content").alias("value"), "doc_id", "chunk_id", F.lit(0).cast("long").alias("at"), "bbox").limit(0)
    return wanted.join(out, "value").select("value_id", "doc_id", "chunk_id", "at", "bbox")
