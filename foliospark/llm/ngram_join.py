"""Exact Jaccard self-join on word shingles, and its components, with set relations used at both levels.

Equal sets are one set. Sets meet in the lists of their rarest shingles (the prefix filter). Entries of a list are skipped
in blocks by size, and singly by their positions: of the shingles before an entry's own only those count whose lists hold
a set of another component, so that a set with many shingles of its own drops out of all lists at once. Last come maps of
bits, which bound what two sets have in common. Answers are
derived from set to set: in each block, sets are held against the one that stands at the front of its order (the one with
the fewest shingles of its own, from which the others were most likely made), and those verified to be like it take over
its component: no pair inside a component is looked at again. Further rounds do the same with leaders of other
components. What is left are pairs between components; they are counted over all lists, and only those that share as many
rare shingles as the threshold implies are verified.

"Rarest" is by a count sketch over all documents, of fixed size: any order gives exact results, and this one keeps common
passages out of the lists. Hot lists are never in one task: leaders are partial aggregates, entries meet them in joins
that are split where a key is hot, and pairs are looked for in tiles of a list."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import flat, forget_all, partitions, slices, spread, texts, written
from foliospark.llm.components import components
from foliospark.llm.packing import LOWER

WORDS = 4
#: Per cent of the union that two sets share to be linked.
SHARE = 85
#: Buckets of the count sketch, and how many travel as one row.
SKETCH, BLOCK = 1 << 20, 1 << 14
#: Sets are held against leaders of other components as long as one in YIELD of the pairs tried is linked, in at most
#: ROUNDS rounds; then the pairs that are left are looked for. Results don't depend on either.
YIELD, ROUNDS = 50, 6
#: Bits of a set's parity map: two maps differ in no more bits than the sets do in shingles.
PARITY = 512
#: 64-bit words in the bitmap of wanted texts: its size doesn't grow, and what it lets through is joined exactly.
BITMAP = 1 << 18
#: Entries of a list that one tile holds of either side, and pairs that one step of a tile holds.
TILE, PAIRS = 4096, 1 << 20
# odd multipliers, from the fractional digits of square roots
MIX = [np.uint64(x | 1) for x in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1)]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[4]
    return h ^ (h >> np.uint64(29))


def shingle_sets(array: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    import xxhash

    data, at = flat(array)
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * len(array)
    data = LOWER[data]
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = ~white & np.append(True, white[:-1])
    start[at[:-1][np.diff(at) > 0]] = True
    begin = np.flatnonzero(start)
    ends = np.append(begin, len(data)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    distinct = [c.strip(b" \t\n\x0b\f\r") for c in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(c) if c else 0 for c in distinct], np.uint64)
    real = np.array([bool(c) for c in distinct])
    which = coded.indices.to_numpy()
    keep = real[which]
    w = hashes[which[keep]]
    bounds = np.searchsorted(begin[keep], at, side="left")
    n = max(0, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(words):
        # a power of its own for each place, or words that change places would give the same shingle
        h = h + w[k : n + k] * np.uint64(pow(int(MIX[k % 4]), k // 4 + 1, 1 << 64))
    h = finish(h)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(h[a : z - words + 1]))
        elif z > a:
            whole = np.array([z - a], np.uint64)
            for i in range(a, z):
                whole = whole * MIX[0] + w[i : i + 1]
            out.append(finish(whole))
        else:
            out.append(empty)
    return out


def prefix_size(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def needed(a, b, share: int):  # noqa: ANN001, ANN201
    """Fewest common shingles of linked sets of these sizes."""
    return -(-share * (a + b) // (100 + share))


def needed_sql(a: str, b: str, share: int) -> Column:
    return F.expr(f"(({share}L * ({a} + {b}) + {99 + share}) div {100 + share})")


def fewest_lists(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Fewest common shingles in the prefixes of linked sets: the first common ones, but as many as either side lacks."""
    return np.maximum(1, needed(a, b, share) + -share * np.maximum(a, b) // 100 + 1)


def shared_least(a: str, b: str, share: int) -> Column:
    """As fewest_lists."""
    return F.greatest(F.lit(1), needed_sql(a, b, share) - F.expr(f"(({share}L * greatest({a}, {b}) + 99) div 100)") + 1)


def sketched(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of shingles by bucket, each document's once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in slices(batches, "text"):
            h = np.concatenate(shingle_sets(b.column("text"), words))
            total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH // BLOCK)), pa.array([x.tobytes() for x in total.reshape(-1, BLOCK)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block long, counts binary"
    parts = docs.select("text").mapInArrow(count, kind).repartition(SKETCH // BLOCK, "block").mapInArrow(add, kind)
    out = np.zeros((SKETCH // BLOCK, BLOCK), np.int64)
    for r in parts.toLocalIterator():  # the sketch, of fixed size
        out[r["block"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def names(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128 bits for each set, in two halves, the same for equal sets; null for empty ones."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
    half = lambda shift: pa.array([None if x is None else int(np.int64(np.uint64(x >> shift & (1 << 64) - 1))) for x in both], pa.int64())
    return half(64), half(0)


def parity(s: np.ndarray) -> np.ndarray:
    """How many shingles of the set fall on each bit, odd or even, as 64-bit words."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near_enough(x: str, y: str, na: str, nb: str, share: int) -> Column:
    """Whether sets of these sizes and parity maps may be linked: they differ in as many shingles as their maps in bits."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return F.col(na) + F.col(nb) - apart >= 2 * needed_sql(na, nb, share)


def keys(text: str = "text") -> list[Column]:
    """128 bits that name a text, in two halves."""
    return [F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2")]


EVERY = "row long, doc_id long, k1 long, k2 long, n long, h1 long, h2 long, prefix binary, bits array<long>"


def prepared(docs: DataFrame, words: int, share: int, into: list[str]) -> DataFrame:
    """A number, the text's name, n (set size), the set's name (null for empty sets) and prefix of every row, written."""
    sketch = docs.sparkSession.sparkContext.broadcast(sketched(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), words)
            pre = [s[np.argsort(counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[: prefix_size(len(s), share)]].tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()), *names(sets), pa.array(pre, pa.binary()), pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["row", "doc_id", "k1", "k2", "n", "h1", "h2", "prefix", "bits"])

    return written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *keys()).mapInArrow(run, EVERY), "sets", into)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        row = pa.array(np.repeat(np.arange(len(lists)), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])), b.column("node").take(row), b.column("n").take(row), pa.array(spread(np.zeros(len(sizes), np.int64), sizes).astype(np.int32))], ["token", "node", "n", "pos"])


def may_link(x: str, y: str, share: int) -> Column:
    """Whether entries x and y (structs) of one list may be linked: by size, and by how many shingles can be common. Before
    the shared one only live shingles can, those whose lists hold more than one set or component."""
    common = F.expr(f"least({x}.live, {y}.live) + least({x}.n - {x}.pos, {y}.n - {y}.pos)")
    lists = F.expr(f"least({x}.live, {y}.live) + least({x}.total - {x}.live, {y}.total - {y}.live)")
    return (common >= needed_sql(f"{x}.n", f"{y}.n", share)) & (lists >= shared_least(f"{x}.n", f"{y}.n", share))


def ranked(entries: DataFrame) -> DataFrame:
    """live: how many shingles of the same set stand before an entry, among those given; total: how many it has of those."""
    mine = Window.partitionBy("node").orderBy("pos", "token")
    every = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return entries.withColumn("live", (F.row_number().over(mine) - 1).cast("int")).withColumn("total", F.count("*").over(every).cast("int"))


def tiles(share: int):  # noqa: ANN201
    """From entries sorted by token and tile (a, b), pairs of different components and how many lists they meet in."""

    def emit(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in (a, b, na, nb)), pa.array(np.diff(np.append(first, len(a))))], ["a", "b", "na", "nb", "lists"])

    def pairs(token, a, b, own, node, n, pos, live, total, comp, bits):  # noqa: ANN001, ANN202
        """Of whole runs of equal (token, a, b), sorted by n within: a partner stands after an entry, as far as sizes allow."""
        run = np.cumsum(np.append(0, (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        most = n * 100 // share
        span = int(max(n.max(), most.max())) + 1
        to = np.searchsorted(run * span + n, run * span + most, side="right")
        count = to - np.arange(len(n)) - 1
        upto, at = np.cumsum(count), 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            x = np.repeat(np.arange(at, stop), count[at:stop])
            y = spread(np.arange(at, stop) + 1, count[at:stop])
            other = (comp[x] != comp[y]) & ((a[x] == b[x]) | (own[x] != own[y]))
            x, y = x[other], y[other]
            before = np.minimum(live[x], live[y])
            able = (before + np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x], n[y], share)) & (before + np.minimum(total[x] - live[x], total[y] - live[y]) >= fewest_lists(n[x], n[y], share))
            x, y = x[able], y[able]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            able = n[x] + n[y] - apart >= 2 * needed(n[x], n[y], share)
            yield node[x[able]], node[y[able]], n[x[able]], n[y[able]]
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        kept: list[tuple] = []
        many = 0

        def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal many
            for found in pairs(*cols):
                if len(found[0]):
                    kept.append(found)
                    many += len(found[0])
                if many >= PAIRS:
                    yield emit(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                    kept.clear()
                    many = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            cols.append(batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1))
            # no tile is torn; one holds 2 x TILE entries on average
            last = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]))[0])
            ends = bool(held) and any(held[-1][i][-1] != cols[i][0] for i in range(3))
            if last or ends:
                yield from whole([np.concatenate(x) for x in zip(*held, [c[:last] for c in cols], strict=True)] if held else [c[:last] for c in cols])
                held = [[c[last:] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield from whole([np.concatenate(x) for x in zip(*held, strict=True)])
        if kept:
            yield emit(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def shingled(docs: DataFrame, wanted: DataFrame, words: int, into: list[str]) -> DataFrame:
    """node, shingles of wanted(node, doc_id, k1, k2), from the texts of one row each, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), words)], pa.binary())], ["node", "shingles"])

    word, bit = F.expr(f"pmod(k1, {64 * BITMAP}L) div 64"), F.expr("shiftleft(1L, cast(pmod(k1, 64) AS INT))")
    bitmap = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))  # BITMAP rows at most
    place = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at")
    # most texts are not wanted, and stop here before any of them is shuffled
    able = docs.select(place, "text", *keys()).withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.col("mask").bitwiseAND(bit) != 0)
    found = able.select("at", "text", "k1", "k2").join(wanted.select("node", place, "k1", "k2"), ["at", "k1", "k2"])
    return written(found.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "shingles", into)


def verified(pairs: DataFrame, sets: DataFrame, share: int, into: list[str]) -> DataFrame:
    """Those of pairs(a, b) that are linked, written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append((100 + share) * common >= share * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return written(both.select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(compare, "u long, v long"), "links", into)


def grouped(docs: DataFrame, words: int = WORDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (the text's name), n (set size), root (the same for rows of one component, null for empty sets) of
    every row, written. Joins on lists are merge joins at every size: both sides grow with the corpus."""
    spark = docs.sparkSession
    read = texts(docs, id_col, text_col)
    scratch: list[str] = []
    every = prepared(read, words, share, scratch)
    once = every.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("row", "doc_id", "k1", "k2")).alias("one"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    once = written(once.select("h1", "h2", F.col("one.row").alias("node"), "one.doc_id", "one.k1", "one.k2", "n", "prefix", "bits"), "classes", scratch)
    entries = once.select("node", "n", "prefix").mapInArrow(postings, "token long, node long, n long, pos int")
    # most shingles are of one set alone
    shared = written(entries.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared", scratch)
    met = ranked(entries.join(shared.hint("merge"), "token")).withColumn("block", F.floor(F.log("n") / math.log(100 / share)).cast("int"))
    met = written(met, "lists", scratch)
    links: list[DataFrame] = []
    sets: list[DataFrame] = []

    def together(into: list[str]) -> DataFrame:
        """node, root by all links so far."""
        return components(reduce(DataFrame.union, links), into) if links else spark.createDataFrame([], "node long, root long")

    def placed(into: list[str]) -> DataFrame:
        """Entries of those lists that still hold several components; live counts only these."""
        mine: list[str] = []
        now = written(met.join(together(mine).hint("merge"), "node", "left").select("token", "node", "n", "pos", "block", F.coalesce("root", "node").alias("comp")), "placed", mine)
        mixed = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
        mixed = written(ranked(now.join(mixed.hint("merge"), "token")), "mixed", into)
        forget_all(spark, mine)
        return mixed

    def checked(pairs: DataFrame, name: str) -> bool:
        """Adds those pairs that are linked to the links; whether they are worth another round."""
        mine: list[str] = []
        worth = False
        tried = written(pairs, name, mine)
        pairs = tried
        for end in ("a", "b"):
            pairs = pairs.join(once.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits_{end}")), end)
        pairs = written(pairs.filter(near_enough("bits_a", "bits_b", "na", "nb", share)).select("a", "b"), name, mine)
        if not pairs.isEmpty():
            ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends", mine)
            wanted = ends
            for known in sets:
                wanted = wanted.join(known.select("node"), "node", "left_anti")
            # as a table its size is known, so that it is broadcast only where small
            wanted = written(once.select("node", "doc_id", "k1", "k2").join(wanted, "node"), "wanted", mine)
            sets.append(shingled(read, wanted, words, scratch))
            links.append(verified(pairs, reduce(DataFrame.union, sets).join(ends, "node", "left_semi"), share, scratch))
            worth = links[-1].count() * YIELD >= tried.count()
        forget_all(spark, mine)
        return worth

    def led(lists: DataFrame) -> bool:
        """Each set against the likeliest leader of its blocks; what is missed here is found between components. Leaders
        are the entry nearest to the front of its order, and those of the smallest and the largest component."""
        lists = lists.withColumn("e", F.struct("pos", F.xxhash64("node").alias("mix"), "node", "n", "live", "total", "comp"))
        heads = lists.groupBy("token", "block").agg(F.min("e").alias("front"), F.min_by("e", F.struct("comp", "e")).alias("low"), F.max_by("e", F.struct("comp", -F.col("pos"), F.xxhash64("node"))).alias("high"))
        heads = heads.select("token", "block", F.explode(F.array_distinct(F.array("front", "low", "high"))).alias("l"))
        near = lists.select("token", "block", "e").join(heads.hint("merge"), ["token", "block"]).filter("e.comp <> l.comp").filter(may_link("e", "l", share))
        pairs = near.groupBy(F.col("l.node").alias("a"), F.col("e.node").alias("b")).agg(F.count("*").alias("lists"), F.first("l.n").alias("na"), F.first("e.n").alias("nb"))
        likely = pairs.filter(2 * F.col("lists") >= shared_least("na", "nb", share))
        return checked(likely.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "best")

    worth, turns = led(met.withColumn("comp", F.col("node"))), 0
    while worth and turns < ROUNDS:
        mine: list[str] = []
        worth, turns = led(placed(mine)), turns + 1
        forget_all(spark, mine)
    left = placed(scratch)
    # lists of a single tile need no further dealing, and are most of them
    size = left.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > TILE).select("token", F.ceil(F.col("c") / TILE).alias("tiles"))
    dealt = left.join(size, "token", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long"))).join(once.select("node", "bits").hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "pos", "live", "total", "comp", "bits")
    dealt = dealt.repartition(partitions(spark), "token", "a", "b").sortWithinPartitions("token", "a", "b", "n", "node")
    cross = dealt.mapInArrow(tiles(share), "a long, b long, na long, nb long, lists long")
    likely = cross.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.first("na").alias("na"), F.first("nb").alias("nb")).filter(F.col("lists") >= shared_least("na", "nb", share))
    checked(likely.select("a", "b"), "likely")
    roots = once.select("h1", "h2", "node").join(together(scratch), "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    done = written(every.select("doc_id", "k1", "k2", "n", "h1", "h2").join(roots.hint("merge"), ["h1", "h2"], "left").select("doc_id", "k1", "k2", "n", "root"), "grouped")
    forget_all(spark, scratch)
    return done


def join(docs: DataFrame, words: int = WORDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have no shingles and link with nothing; rows that repeat, and different texts of one doc_id, are
    nodes by their texts; a null doc_id is in a component but never names one unless alone; an empty table gives no rows;
    other columns are not read."""
    placed = grouped(docs, words, share, id_col, text_col)
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    return placed.join(least.hint("merge"), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component: that of the smallest doc_id, a null one coming last, and then of the smallest
    name of the text; of rows equal in doc_id and text one. Rows without shingles stay, all of them. All columns stay."""
    placed = grouped(docs, words, share, id_col, text_col).filter("root is not null")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "k1", "k2")
    texts_of = placed.groupBy("root", name.alias("name")).agg(F.count("*").alias("copies"))
    first = texts_of.groupBy("root").agg(F.min("name").alias("first"))
    fate = texts_of.join(first, "root").select("name.*", "copies", (F.col("name") == F.col("first")).alias("stays")).filter("copies > 1 or not stays")
    fate = written(fate.select(F.col("unnamed").alias("__u"), F.col("doc_id").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), "copies", "stays"), "fate")
    id_ = F.col(id_col).cast("long")
    k1, k2 = (k for k in keys(text_col))
    named = docs.withColumn("__u", id_.isNull()).withColumn("__d", F.coalesce(id_, F.lit(0))).withColumn("__1", k1).withColumn("__2", k2)
    on = ["__u", "__d", "__1", "__2"]
    untouched = named.join(fate.select(*on), on, "left_anti")
    single = named.join(fate.filter("stays").select(*on), on, "left_semi").dropDuplicates(on)
    return untouched.unionByName(single).select(*docs.columns)
