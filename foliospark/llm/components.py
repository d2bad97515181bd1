"""Connected components of a link table, without ever holding it in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import written

#: Links that one step of the local pass holds at once. No more than these, and one task finishes them in a single step.
HELD = 1 << 18


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these links, and the smallest node that each reaches by them."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        nodes, root = smallest(u, v)
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD:
            yield out()
            held = []
    if held:
        yield out()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _local for at most HELD links in one task: final."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if held:
        nodes, root = smallest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["node", "root"])


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(links: DataFrame, into: list[str] | None = None) -> DataFrame:
    """node, root of every node of links(u long, v long) that isn't the smallest of its component.

    Links within a task are contracted first. If at most HELD are left, one task finishes them; else large and small stars alternate until they change nothing, each round
    written to the shared folder. Hubs cost no more than their links: minima are partial aggregates, and what joins them
    back is split where a key is hot. Paths of its tables are added to `into`, as by `written`. An empty table, and links of
    a node with itself, give no rows; a link with a null end counts for nothing."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().mapInArrow(_local, "u long, v long").distinct(), "links", into)
    state = _state(now)
    if state[0] <= HELD:
        return now.coalesce(1).mapInArrow(_whole, "node long, root long")
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v")
        now = written(small.distinct(), "links", into)
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
