"""Shards of near-equal bytes: the smallest capacity for a contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by a 64-bit hash of the text. The driver never holds them all: it sees at first a
histogram of the hash's leading bits, and then finer histograms of those ranges alone in which some shard could end,
until these ranges hold one group each. The binary search then runs as if every group were there."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import numbered, partitions, texts, written

#: Leading bits of the hash in the first histogram, and further bits in each finer one.
BITS, FINER = 12, 6
#: Bytes that each row counts beside its text.
OVERHEAD = 16
LAW = "bytes"


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Numbers of items before each cut, filling shard after shard; None if `shards` are too few."""
    cuts, at, base = [], 0, 0
    while at < len(ends):
        to = bisect_right(ends, base + capacity)
        if to == at or len(cuts) == shards:
            return None
        cuts.append(to)
        at, base = to, ends[to - 1]
    return cuts


def smallest(ends: list[int], low: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity from low on that suffices, and its cuts."""
    high = max(low, ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return high, greedy(ends, high, shards) or []


def open_ranges(items: list[tuple[int, int, int, int]], low: int, high: int, shards: int) -> set[int]:
    """Items of several groups in which a shard may end, for some capacity from low to high."""
    ends = list(accumulate(x[2] for x in items))
    found, least, most = set(), 0, 0
    for _ in range(shards):
        to = bisect_right(ends, least + low)
        least, most = ends[to - 1] if to else 0, most + high
        stop = bisect_right(ends, most)
        found.update(i for i in range(to, min(stop + 1, len(items))) if items[i][3] > 1)
    return found


def cut_points(groups: DataFrame, shards: int, top: int) -> list[int]:
    """First hashes of the second, third, ... shard over groups(g long, w long)."""
    if not shards:
        return []
    shift, items, chosen = 64 - BITS, [], None
    while True:
        part = groups if chosen is None else groups.join(F.broadcast(groups.sparkSession.createDataFrame([(x,) for x in chosen], "_k long")), F.shiftright("g", shift + FINER) == F.col("_k"), "left_semi")
        # at most 2^BITS rows at first, then at most 2^FINER for each open range, whatever the number of groups
        rows = part.groupBy(F.shiftright("g", shift).alias("k")).agg(F.min("g").alias("g"), F.sum("w").alias("w"), F.count("*").alias("n")).collect()
        fresh = [(r["g"], r["k"], r["w"], r["n"]) for r in rows]
        kept = items if chosen is None else [x for i, x in enumerate(items) if i not in opened]
        items = sorted([*((g, k, w, n) for g, k, w, n in kept), *fresh])
        if not items:
            return []
        ends = list(accumulate(x[2] for x in items))
        low = max(-(-ends[-1] // shards), top)
        high, cuts = smallest(ends, low, shards)
        opened = open_ranges(items, low, high, shards) if shift else set()
        if not opened:
            return [items[c][0] for c in cuts if c < len(items)]
        step = min(FINER, shift)
        # ranges that were not opened before keep coarser keys; bring the keys of open ones to the present shift
        chosen = sorted({items[i][0] >> shift for i in opened})
        shift -= step
        if step < FINER:
            return [items[c][0] for c in cuts if c < len(items)]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Equal texts stay together. A group of at least an equal share of the bytes has a shard of its own, and the others
    share the rest. Null texts count as empty ones; rows that repeat get a slot each; an empty table gives no rows; other
    columns are not read."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(texts(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g")), "rows")
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("w")), "groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    largest = [(r["g"], r["w"]) for r in groups.orderBy(F.desc("w"), "g").limit(shards + 1).collect()]
    alone, rest = [], total
    while len(alone) < min(shards - 1, len(largest)) and largest[len(alone)][1] * (shards - len(alone)) >= rest:
        rest -= largest[len(alone)][1]
        alone.append(largest[len(alone)][0])
    others = groups.filter(~F.col("g").isin(alone)) if alone else groups
    top = largest[len(alone)][1] if len(largest) > len(alone) else 0
    cuts = cut_points(others, shards - len(alone), top)
    first = F.lit(len(alone)) + (F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("g"))) if cuts else F.lit(0))
    own = F.lit(None).cast("int")
    for i, g in enumerate(alone):
        own = F.when(F.col("g") == g, i).otherwise(own)
    placed = rows.withColumn("shard", F.coalesce(own, first).cast("int"))
    slots = numbered(placed, ["shard"], [F.col(c) for c in ("g", "doc_id", "size", "text_crc32")], "slot", partitions(spark))
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
