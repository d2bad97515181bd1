"""Profiles of taxpayers: what was read from documents of three kinds, stitched into entries of one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.dynamic import unwrapped

# Kinds of documents, and the list field that holds a document's entries; without one it is an entry itself.
ENTRIES = {"form16": None, "fd_interest": "fd_entries", "stocks": "transactions"}


def stitched(key: str, **documents: DataFrame) -> DataFrame:
    """key, source, document_id, position, error, and a column for each source with its entry: one row an entry, and one for a
    document that couldn't be read.

    documents: by the names of ENTRIES, each with key, document_id, error, extracted (a record; {value, bbox} records count as
    their values at any depth). A document with an error has no entries, whatever it holds besides; a null record without an
    error is an entry of nulls for form16, and none for lists; a null or empty list has no entries, and a null item is one.
    position is that in the list, from 0. Nothing moves: entries of one taxpayer needn't meet, so that one who has most of the
    documents is no burden; nothing is added up across documents either."""
    kinds, parts = {}, {}
    for source, df in documents.items():
        held = df.select(F.col(f"`{key}`").alias(key), "document_id", "error", unwrapped(F.col("extracted"), df.schema["extracted"].dataType).alias("_x"))
        field = ENTRIES[source]
        kind = held.schema["_x"].dataType
        fails = F.col("error").isNotNull()
        if field:
            kinds[source] = kind[field].dataType.elementType
            entries = F.coalesce(F.col("_x")[field], F.array().cast(kind[field].dataType))
            one = F.transform(entries, lambda e, i: F.struct(i.alias("position"), e.alias("entry")))
        else:
            kinds[source] = kind
            one = F.array(F.struct(F.lit(0).alias("position"), F.col("_x").alias("entry")))
        failed = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(None).cast(kinds[source]).alias("entry")))
        parts[source] = held.select(key, F.lit(source).alias("source"), "document_id", "error", F.explode(F.when(fails, failed).otherwise(one)).alias("_e"))
    each = [p.select(key, "source", "document_id", "_e.position", "error", *((F.col("_e.entry") if s == source else F.lit(None).cast(k)).alias(s) for s, k in kinds.items())) for source, p in parts.items()]
    return reduce(DataFrame.unionByName, each)


def totals(entries: DataFrame, key: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """By key: entries of each source, errors, and sums by name of (source, field), to two places; fields that are no numbers, as
    texts or nulls, count 0."""
    counts = [F.count_if(F.col("error").isNull() & (F.col("source") == s)).alias(f"{s}_entries") for s in ENTRIES if s in entries.columns]
    number = lambda s, f: F.coalesce(F.col(s)[f].cast("string").try_cast("double"), F.lit(0.0))
    return entries.groupBy(key).agg(*counts, F.count_if(F.col("error").isNotNull()).alias("errors"), *(F.round(F.sum(number(s, f)), 2).alias(name) for name, (s, f) in sums.items()))
