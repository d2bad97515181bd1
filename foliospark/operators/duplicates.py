"""Candidates that are one person, and what their records contradict.

Records with an equal normalised e-mail, telephone or name (with a second field) are linked to the first of their block, and
the links' connected components are the groups. Blocks are aggregates, so a hot one costs a row for each record and no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.strings import stripped
from foliospark.session import written

#: Digits of a telephone number that count, from its end, and the fewest of a number that can be compared.
TAIL, LEAST = 10, 7


def email_key(email: Column) -> Column:
    key = F.lower(stripped(email))
    return F.when(F.contains(key, F.lit("@")), key)


def phone_key(phone: Column) -> Column:
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= LEAST, F.right(digits, F.lit(TAIL)))


def name_key(name: Column) -> Column:
    words = F.array_sort(F.filter(F.split(F.lower(F.regexp_replace(name, r"[.,]", " ")), r"\s+"), lambda w: w != ""))
    return F.when(F.size(words) > 1, F.array_join(words, " "))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of links(u, v) reaches, itself included.

    Large and small stars in turn, until nothing changes: every node is hung on the smallest neighbour of its own, so that
    chains halve. Minima are aggregates, and what joins them back is split where a node is hot."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).filter("node is not null").distinct()
    state = None
    while (new := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != state:
        state = new
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v")
        now = written(small.distinct(), "links")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def groups(people: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """id, root, size of every record: those that share any key have one root, the smallest id. A null key links nothing; ids
    are distinct and not null."""
    every = people.select("id", F.explode(F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k.cast("string"))) for n, k in keys.items()))).alias("block")).filter("block is not null")
    first = every.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    links = every.join(first, "block").select(F.col("id").alias("u"), F.col("first").alias("v"))
    roots = written(people.select("id").join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
    return roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").select("id", "root", "size")


def contradictions(people: DataFrame, grouped: DataFrame, fields: list[str]) -> DataFrame:
    """root, size, fields of each group of two or more: the fields, in their order, of which it has several values. Nulls
    and outer white space and case don't contradict. people(id, fields ..)."""
    cells = people.join(grouped.filter("size > 1"), "id").select("root", "size", F.posexplode(F.array(*(F.lower(stripped(F.col(f).cast("string"))) for f in fields))).alias("i", "value"))
    spans = cells.groupBy("root", "size", "i").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    differs = F.sort_array(F.collect_list(F.when(F.col("low") != F.col("high"), F.col("i"))))
    return spans.groupBy("root", "size").agg(F.transform(differs, lambda i: F.get(F.array(*map(F.lit, fields)), i)).alias("fields"))
