"""Near-duplicate vectors by spherical-cap filters.

Filter directions are all pairs of codewords of two half-space codes. A vector is list-decoded to all directions whose
inner product reaches its own cap, which is set so that `hits` directions do: the codewords of either half are sorted by
their products, and only the staircase of leading pairs can hold the best sums, so no vector is ever held against all
directions. Two vectors of high cosine share some direction almost surely (`hits` gives the measured misses). A vector travels once
for each first codeword among its directions, with its second codewords there: vectors meet on label and first codeword,
and within such a bucket only those of one second codeword are held against each other, in double precision. A pair counts
in the smallest direction that it shares; directions of vectors with a near one are decoded again where that is asked.
Equal vectors are one vector with a multiplicity. Large buckets are verified in tiles, each a task's work; no pair leaves a
task, only counts of links and one link to the smallest vector of each tile's component."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget_all, partitions, written
from foliospark.llm.components import components, smallest

COSINE = 0.93
#: Rows of a bucket, and bytes of their vectors, that one tile holds of either side; rows held against as many at once.
TILE, TILE_BYTES, BLOCK = 1 << 15, 16 << 20, 1024
#: Directions that are looked at once for pairs that share some.
COLUMNS = 4096
#: Directions grow with the vectors so that a bucket has about this many by chance.
BY_CHANCE = 64
SEED = 20
CAPS = "cls long, label long, n long, x binary, first int, seconds binary"


def codewords(dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit directions for the first and the second half of a vector."""
    rng = np.random.default_rng(SEED)
    halves = [rng.standard_normal((size, d)) for d in (dim - dim // 2, dim // 2)]
    return tuple((h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)).astype(np.float32) for h in halves)


def hits(size: int) -> int:
    """Directions that reach a vector's cap. The number grows with the codes, so that recall doesn't fall with the table: of
    4000 pairs of 64 dimensions at a cosine of 0.931, 1 was missed at 64 codewords a half, and 0 at 256, 1024 and 4096."""
    return min(size * size, max(20, math.ceil(2.5 * math.sqrt(size))))


def codeword_count(n: int) -> int:
    """Codewords a half for n vectors: as many as keep a bucket at about BY_CHANCE by chance, at any n."""
    size = 16
    while n * hits(size) > 4 * BY_CHANCE * size * size:
        size *= 2
    return size


def list_decoded(u: np.ndarray, codes: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and direction of all directions at or above each row's cap, the `most`-th best sum, in order of direction."""
    size, half = len(codes[0]), codes[0].shape[1]
    k = min(most, size)
    tops, order = [], []
    for s in (u[:, :half] @ codes[0].T, u[:, half:] @ codes[1].T):
        best = np.argpartition(-s, k - 1, 1)[:, :k]
        value = np.take_along_axis(s, best, 1)
        sort = np.argsort(-value, 1, kind="stable")
        tops.append(np.take_along_axis(value, sort, 1))
        order.append(np.take_along_axis(best, sort, 1).astype(np.int64))
    # the pair (i, j) has (i + 1) (j + 1) - 1 pairs before it that are no worse
    stairs = np.array([(i, j) for i in range(k) for j in range(min(k, most // (i + 1)))])
    sums = tops[0][:, stairs[:, 0]] + tops[1][:, stairs[:, 1]]
    cap = -np.partition(-sums, most - 1, 1)[:, most - 1, None]
    row, at = np.nonzero(sums >= cap)
    found = order[0][row, stairs[at, 0]] * size + order[1][row, stairs[at, 1]]
    sort = np.lexsort((found, row))
    return row[sort], found[sort]


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, x: x is null unless the vector can link."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    largest = F.array_max(F.transform(x, lambda v: F.abs(v)))  # NaN is the largest of all
    able = F.col(label_col).isNotNull() & ~F.exists(x, lambda v: v.isNull()) & ~F.isnan(largest) & (largest > 0) & (largest < float("inf"))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(able, x).alias("x"))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. They are brought to a size near 1 by a power of two first, so that no square is lost."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sharing(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, below: int) -> np.ndarray:
    """For each pair of left and right, places in lists, whether they share a number below that one."""
    found = np.zeros((len(left), len(right)), bool)
    owner, value = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    owner, value = owner[value < below], value[value < below]
    _, column, n = np.unique(value, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n > 1)
    rank = np.cumsum(n > 1) - 1
    keep = n[column] > 1
    owner, column = owner[keep], rank[column[keep]]
    for s in range(0, len(twice), COLUMNS):
        mine = (column >= s) & (column < s + COLUMNS)
        mark = np.zeros((len(lists), min(COLUMNS, len(twice) - s)), np.float32)
        mark[owner[mine], column[mine] - s] = 1
        found |= mark[left] @ mark[right].T > 0
    return found


def met(first: np.ndarray, second: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places with one number in both sorted arrays, in blocks; of one array alone each pair of blocks once."""
    own = first if second is None else second
    values = np.unique(first)
    starts, ends, to, until = (np.searchsorted(x, values, side) for x, side in ((first, "left"), (first, "right"), (own, "left"), (own, "right")))
    busy = np.flatnonzero((ends - starts > 1) if second is None else until > to)
    for s, e, t, u in zip(starts[busy].tolist(), ends[busy].tolist(), to[busy].tolist(), until[busy].tolist(), strict=True):
        for i in range(s, e, BLOCK):
            for j in range(i if second is None else t, u, BLOCK):
                yield np.arange(i, min(e, i + BLOCK)), np.arange(j, min(u, j + BLOCK))


def links(classes: DataFrame, dim: int, size: int, cosine: float, kind: str = "f8") -> DataFrame:
    """cls, n_links (by multiplicity) and root, one row for each class and tile where it has a link."""
    codes = codewords(dim, size)
    most = hits(size)
    tile = max(1, min(TILE, TILE_BYTES // (8 * dim)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // (size + most * 8))
        for big in batches:
            for i in range(0, big.num_rows, step):
                b = big.slice(i, step)
                x = np.array(b.column("x").flatten()).reshape(b.num_rows, dim)
                row, f = list_decoded(directions(x).astype(np.float32), codes, most)
                first, second = f // size, (f % size).astype("<i4")
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1])]))
                take = pa.array(row[new])
                seconds = pa.array([part.tobytes() for part in np.split(second, new[1:])], pa.binary())
                vector = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()).take(take)
                yield pa.RecordBatch.from_arrays([b.column("cls").take(take), b.column("label").take(take), b.column("n").take(take), vector, pa.array(first[new].astype(np.int32)), seconds], ["cls", "label", "n", "x", "first", "seconds"])

    caps = classes.mapInArrow(decode, CAPS)
    sizes = caps.groupBy("label", "first").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("tiles", F.ceil(F.col("rows") / tile))
    own = caps.join(sizes, ["label", "first"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    tiled = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("cls", "n", "x", "seconds", "label", "first", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.col("own"))
    keys = ["label", "first", "a", "b"]
    dealt = tiled.repartition(partitions(classes.sparkSession), *keys).sortWithinPartitions(*keys, "cls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            own, cls, n = (t.column(c).to_numpy() for c in ("own", "cls", "n"))
            a, b, first = t.column("a")[0].as_py(), t.column("b")[0].as_py(), t.column("first")[0].as_py()
            x = directions(_matrix(t.column("x").combine_chunks(), kind))
            lists = [np.frombuffer(y, "<i4") for y in t.column("seconds").to_pylist()]
            row, second = np.repeat(np.arange(len(lists)), [len(y) for y in lists]), np.concatenate(lists)
            sort = np.argsort(second, kind="stable")
            row, second = row[sort], second[sort]
            sides = [own[row] == a, None if a == b else own[row] == b]
            left, right = (None if s is None else (row[s], second[s]) for s in sides)
            count, joined, decoded = np.zeros(len(cls), np.int64), [], {}
            for p, q in met(left[1], None if right is None else right[1]):
                f = first * size + int(left[1][p[0]])
                same = right is None and p[0] == q[0]
                p, q = left[0][p], (left if right is None else right)[0][q]
                near = x[p] @ x[q].T >= cosine
                if same:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                joined.append(smallest(cls[p[i]], cls[q[j]]))
                # pairs that share a smaller direction count there
                u, v = np.unique(i), np.unique(j)
                busy = np.unique(np.concatenate([p[u], q[v]]))
                if missing := [k for k in busy.tolist() if k not in decoded]:
                    for lo in range(0, len(missing), BLOCK):
                        part = missing[lo : lo + BLOCK]
                        r, g = list_decoded(x[part].astype(np.float32), codes, most)
                        decoded.update(zip(part, np.split(g, np.flatnonzero(np.diff(r)) + 1), strict=True))
                shared = sharing([decoded[k] for k in busy.tolist()], np.searchsorted(busy, p[u]), np.searchsorted(busy, q[v]), f)
                fresh = near[np.ix_(u, v)] & ~shared
                count[p[u]] += fresh @ n[q[v]]
                if not same:
                    count[q[v]] += n[p[u]] @ fresh
            if joined:
                nodes, root = smallest(*(np.concatenate([x[k] for x in joined]) for k in (0, 1)))
                at = np.argsort(cls)
                counts = count[at[np.searchsorted(cls, nodes, sorter=at)]]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts), pa.array(root)], ["cls", "n_links", "root"])

    return dealt.mapInArrow(verify, "cls long, n_links long, root long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *change.tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def dedup(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Null, zero and non-finite vectors and those without a label link with nothing; vectors of different lengths don't
    link; rows that repeat, with one vec_id too, are vectors of their own; a null vec_id links like others but names a
    component only where it has no other, and is kept only there; an empty table gives no rows; other columns are not
    read."""
    spark = df.sparkSession
    scratch: list[str] = []
    x = F.col("x")
    every = vectors(df, id_col, vec_col, label_col).withColumn("k1", F.when(x.isNotNull(), F.xxhash64("label", x))).withColumn("k2", F.when(x.isNotNull(), F.xxhash64(F.lit(1), "label", x)))
    every = written(every.withColumn("row", F.monotonically_increasing_id()), "vectors", scratch)
    able = every.filter("x is not null")
    classes = written(able.groupBy("k1", "k2").agg(F.min("row").alias("cls"), F.min("label").alias("label"), F.count("*").alias("n"), F.first("x").alias("x")), "classes", scratch)
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()}
    # single-precision input travels as such, and loses nothing
    kind = "f4" if dict(df.dtypes)[vec_col] == "array<float>" else "f8"
    found = spark.createDataFrame([], "cls long, n_links long, root long")
    for d, n in dims.items():
        found = found.unionByName(links(classes.filter(F.size("x") == d), d, codeword_count(n), cosine, kind))
    found = written(found, "found", scratch)
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")), scratch)
    counts = found.groupBy("cls").agg(F.sum("n_links").alias("outer_links"))
    full = classes.select("k1", "k2", "cls", "n").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    joined = every.select("vec_id", "row", "k1", "k2").join(full, ["k1", "k2"], "left")
    done = joined.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("outer_links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "cls", "row").alias("root"))
    done = written(done, "counted")
    forget_all(spark, scratch)
    # names are numbers of rows within; by their smallest vec_id outside
    least = done.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return done.join(least, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
