"""Mixing of sources to target weights, by weighted sampling without replacement.

A source takes its documents whole for as many epochs as fit into its target; of the rest a sample is taken whose keys are
exponential draws divided by each document's quality weight (smallest keys first), as far as the words that are left go.
Keys are sums over a fixed number of buckets, equally full where weights are equal; a source's sorted prefix is that of
its buckets, and only the bucket in which the words run out is sorted itself. Draws come from a hash of the id, so that
a rerun on any cluster agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import forget_all, written

#: Weights of the sources by code point, repeating; most epochs of one source; weights of documents of known quality.
SHARES, EPOCHS = (5, 2, 1), 3
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0
#: Buckets of a source's keys: one of them is sorted.
BUCKETS = 1024
SEED = 1
WORD = r"[^\x20\x09-\x0D]+"
HEX = 13


def sized(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words; a null text has none), weight: UNKNOWN, or by the document's quality label, the best of
    several. Rows without an id, and labels without one, have no label."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if labels is None:
        return own.withColumn("weight", F.lit(UNKNOWN))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN)
    return own.join(known, "doc_id", "left").select("doc_id", "source", "size", weight.alias("weight"))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs(doc_id, weight, ..) with the key of each, and its bucket. A weight that is null, or not above 0, comes last."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, HEX), 16, 10).cast("double")
    able = F.col("weight") > 0
    key = F.when(able, -F.log((drawn + 1) / F.lit(float(16**HEX + 1))) / F.col("weight")).otherwise(F.lit(float("inf")))
    return docs.withColumn("key", key).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))


def targets(totals: DataFrame, shares: tuple[int, ...] = SHARES, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of totals(source, source_size), one row a source.

    Sources share all words by weight; none takes more than `epochs` times its own, and what is over is shared again by the
    others' weights. The sources that are cut down are those of the smallest size for their weight, so one sorted pass
    finds them: a source is cut if its size is short of what would be shared with it and all after it."""
    every, by_name = Window.partitionBy(), Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    own = F.get(F.array(*[F.lit(float(s)) for s in shares]), (F.row_number().over(by_name) - 1) % len(shares))
    weighed = totals.select("source", F.coalesce("source_size", F.lit(0)).cast("double").alias("s"), own.alias("w"))
    by_room = Window.partitionBy().orderBy(F.col("s") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    swept = weighed.select("source", "s", "w", F.sum("s").over(every).alias("all"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("cut"), F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    short = epochs * F.col("s") <= (F.col("all") - epochs * F.col("cut")) * F.col("w") / F.col("open")
    marked = swept.withColumn("short", short)
    left = marked.withColumn("rest", F.max("all").over(every) - epochs * F.sum(F.when(F.col("short"), F.col("s")).otherwise(0.0)).over(every)).withColumn("share", F.sum(F.when(F.col("short"), 0.0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("short"), epochs * F.col("s")).otherwise(F.col("rest") * F.col("w") / F.col("share"))
    return left.select("source", F.col("s").cast("long").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, shares: tuple[int, ...] = SHARES, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, source, size, weight, ..) with source_size, target and taken: size times the copies that the mix has.

    The document at which the words run out is taken if that comes no further from the target. Sources that are null are one
    source, the last; rows that repeat are documents each; a document without words takes none; without any words all
    targets are 0; an empty table gives no rows; other columns stay."""
    ready = keyed(docs, seed)
    buckets = ready.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    scratch: list[str] = []
    buckets = written(buckets, "buckets", scratch)
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), shares, epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket")
    placed = buckets.withColumn("base", F.sum("words").over(running) - F.col("words"))
    same = placed.alias("b").join(goals.alias("g"), F.expr("b.source <=> g.source")).select("g.*", "b.bucket", "b.base", "b.words")
    # the last bucket that starts within the rest is where the words run out, or end
    last = F.max(F.when(F.col("base") <= F.col("rest"), F.struct("bucket", "base"))).alias("last")
    edges = written(same.groupBy("source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "full", "rest")), last).select("source", "source_size", "target", "full", "rest", "last.bucket", "last.base"), "edges")
    forget_all(docs.sparkSession, scratch)
    met = ready.alias("d").join(edges.alias("e"), F.expr("d.source <=> e.source"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    found = ["source_size", "target", "full", "rest"]
    at, own = F.col("e.bucket"), F.col("d.bucket")
    clear = met.filter(own != at).select(*columns, *(F.col(f"e.{c}") for c in found), (own < at).cast("long").alias("drawn"))
    inner = met.filter(own == at).select(*columns, *(F.col(f"e.{c}") for c in found), F.col("d.key").alias("key"), F.col("e.base").alias("base"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("drawn", (2 * (F.col("base") + upto) - F.col("size") <= 2 * F.col("rest")).cast("long")).drop("key", "base")
    return clear.unionByName(inner).withColumn("taken", F.col("size") * (F.col("full") + F.col("drawn"))).withColumn("copies", F.col("full") + F.col("drawn")).drop("full", "rest", "drawn")


def copies(mixed: DataFrame, name: str = "copy") -> DataFrame:
    """The mix itself: each row as many times as it is taken, numbered from 0."""
    return mixed.filter("copies > 0").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")


#: DuckDB SQL of what op13 returns.
SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{WORD}')) AS size,
-ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, {HEX}) AS BIGINT) + 1) / {16**HEX + 1}.0::DOUBLE) / CASE q WHEN 1 THEN {GOOD} WHEN 0 THEN {POOR} ELSE {UNKNOWN} END AS k FROM documents d LEFT JOIN l USING (doc_id)),
t AS (SELECT source, sum(size)::DOUBLE AS s, [{", ".join(map(str, SHARES))}][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SHARES)} AS INT)]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT source, s, w, false AS cut, 0 AS round FROM t UNION ALL
SELECT source, s, w, cut OR {EPOCHS} * s <= ((sum(s) OVER ()) - sum(CASE WHEN cut THEN {EPOCHS} * s ELSE 0 END) OVER ()) * w / (sum(CASE WHEN cut THEN 0 ELSE w END) OVER ()), round + 1 FROM f WHERE round <= (SELECT count(*) FROM t)),
e AS (SELECT source, s, w, cut FROM f WHERE round = (SELECT count(*) FROM t)),
g AS (SELECT source, s, CASE WHEN cut THEN {EPOCHS} * s ELSE ((sum(s) OVER ()) - sum(CASE WHEN cut THEN {EPOCHS} * s ELSE 0 END) OVER ()) * w / (sum(CASE WHEN cut THEN 0 ELSE w END) OVER ()) END AS target FROM e),
r AS (SELECT d.doc_id, d.size, CAST(g.s AS BIGINT) AS source_size, g.target, CASE WHEN g.s > 0 THEN floor(g.target / g.s) ELSE 0 END AS whole, g.s,
sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * s) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
