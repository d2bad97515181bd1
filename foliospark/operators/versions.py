"""Differences between versions of long documents, by anchors.

Versions come as pages. Pairs of at most WHOLE code points travel as one row each, and all of the following is done where
that row is; words of longer ones travel as rows, with the same result. Words that are unique on both sides of a pair, in the longest run
that rises on both, are anchors; they cut a pair into segments that are rows of their own, so a pair's words never meet in
one task. Only places of anchors do, two numbers each. Within a segment the same is done again with what is unique there,
and the shortest edit script ends it."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import written

#: Code points of both versions up to which a pair's pages meet as one row; words of longer pairs travel as rows.
WHOLE = 1 << 17
#: Edits that the shortest script of a segment without anchors is looked for with; beyond them it is replaced whole.
EDITS = 400
RUNS = "segment long, i int, kind string, page_a int, page_b int, n_words long, words string"


def words(pages: DataFrame) -> DataFrame:
    """key, side, page_num, pos, word, place (rising through the version) of pages(key, side, page_num, content)."""
    split = F.filter(F.split("content", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = pages.select("key", "side", "page_num", F.posexplode(split).alias("pos", "word"))
    return each.withColumn("place", F.col("page_num").cast("long") * (1 << 32) + F.col("pos"))


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides."""
    pairs = sorted(pairs)
    tails, ends, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        tails[k : k + 1], ends[k : k + 1] = [b], [i]
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def anchors(every: DataFrame) -> DataFrame:
    """key, side, place of the anchors of each pair, of words(every)."""
    side = lambda s, f, c: f(F.when(F.col("side") == s, F.col(c)))
    once = every.groupBy("key", "word").agg(side("a", F.count, "place").alias("n"), side("b", F.count, "place").alias("m"), side("a", F.min, "place").alias("a"), side("b", F.min, "place").alias("b")).filter("n = 1 and m = 1").select("key", "a", "b")

    def run(group: pa.Table) -> pa.Table:
        kept = rising(list(zip(group.column("a").to_pylist(), group.column("b").to_pylist(), strict=True)))
        return pa.table({"key": group.column("key").slice(0, 1).combine_chunks().take(pa.array([0] * len(kept), pa.int64())), "a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    found = once.groupBy("key").applyInArrow(run, f"key {dict(every.dtypes)['key']}, a long, b long")
    return found.select("key", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("place")), F.struct(F.lit("b").alias("side"), F.col("b").alias("place")))).alias("x")).select("key", "x.side", "x.place")


def script(a: list[str], b: list[str], most: int = EDITS) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of runs in order, places of a for what is unchanged or removed and of b for what is added."""
    out: list[tuple[str, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        if i < 0:  # a stretch that is known, after all that stands before it
            out.append(("unchanged", j, q))
            continue
        head = 0
        while i + head < p and j + head < q and a[i + head] == b[j + head]:
            head += 1
        tail = 0
        while p - tail > i + head and q - tail > j + head and a[p - tail - 1] == b[q - tail - 1]:
            tail += 1
        if head:
            out.append(("unchanged", i, i + head))
        i, j, p, q = i + head, j + head, p - tail, q - tail
        if tail:
            todo.append((-1, 0, p, p + tail))
        if i == p or j == q:
            out += [x for x in (("removed", i, p), ("added", j, q)) if x[1] < x[2]]
            continue
        n, m = Counter(a[i:p]), Counter(b[j:q])
        where = {w: k for k, w in enumerate(b[j:q], j) if m[w] == 1}
        shared = rising([(k, where[w]) for k, w in enumerate(a[i:p], i) if n[w] == 1 and w in where])
        if shared:
            edges = [(i, j), *shared, (p, q)]
            todo += [(s, u, t, v) for (s, t), (u, v) in zip(edges, edges[1:], strict=False)][::-1]
        else:
            out += shortest(a, b, i, p, j, q, most)
    return out


def shortest(a: list[str], b: list[str], i: int, p: int, j: int, q: int, most: int) -> list[tuple[str, int, int]]:
    """The shortest edits of a[i:p] to b[j:q] by furthest reaching paths; both replaced whole beyond `most` edits."""
    n, m, far, trace = p - i, q - j, {1: 0}, []
    for d in range(min(most, n + m) + 1):
        trace.append(dict(far))
        for k in range(-d if d <= m else -m + (d - m) % 2, (d if d <= n else n - (d - n) % 2) + 1, 2):
            x = far[k + 1] if far.get(k - 1, -1) < far.get(k + 1, -1) else far[k - 1] + 1
            while x < n and x - k < m and a[i + x] == b[j + x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                return walked(trace, i, j, n, m)
    return [("removed", i, p), ("added", j, q)]


def walked(trace: list[dict[int, int]], i: int, j: int, x: int, y: int) -> list[tuple[str, int, int]]:
    steps = []
    for d in range(len(trace) - 1, 0, -1):
        far, k = trace[d], x - y
        before = k + 1 if far.get(k - 1, -1) < far.get(k + 1, -1) else k - 1
        u = far[before]
        v = u - before
        start = (u, v + 1) if before > k else (u + 1, v)
        if x > start[0]:
            steps.append(("unchanged", i + start[0], i + x))
        steps.append(("added", j + v, j + v + 1) if before > k else ("removed", i + u, i + u + 1))
        x, y = u, v
    if x:
        steps.append(("unchanged", i, i + x))
    return steps[::-1]


def joined(runs: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Neighbouring runs of a kind as one; between unchanged ones what is removed stands before what is added."""
    out: list[tuple[str, int, int]] = []
    held: dict[str, list[tuple[int, int]]] = {"removed": [], "added": []}

    def settle() -> None:
        for kind, parts in held.items():
            if parts:
                out.append((kind, parts[0][0], parts[-1][1]))
                parts.clear()

    for kind, s, e in runs:
        if kind != "unchanged":
            held[kind].append((s, e))
            continue
        settle()
        if out and out[-1][0] == "unchanged":
            s = out.pop()[1]
        out.append(("unchanged", s, e))
    settle()
    return out


RUN_COLUMNS = ["key", "segment", "i", "kind", "page_a", "page_b", "n_words", "words"]
RUN_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]


def runs_of(segment: int, a: list[str], b: list[str], page_a: list[int], page_b: list[int], most: int) -> list[tuple]:
    """Rows of the runs of one segment, without the key."""
    out = []
    for i, (kind, s, e) in enumerate(joined(script(a, b, most))):
        words, page = (b, page_b[s]) if kind == "added" else (a, page_a[s])
        out.append((segment, i, kind, None if kind == "added" else page, page if kind == "added" else None, e - s, " ".join(words[s:e])))
    return out


def cut(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the anchors of a whole pair, on both sides."""
    n, m = Counter(a), Counter(b)
    where = {w: k for k, w in enumerate(b) if m[w] == 1}
    return rising([(k, where[w]) for k, w in enumerate(a) if n[w] == 1 and w in where])


def whole(pages: DataFrame, most: int) -> DataFrame:
    """`diff` of short pairs: a row has the pages of both versions."""
    split = F.filter(F.split("content", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.array_join(split, " ").alias("words")
    own = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("page_num", "words")))).alias(s)
    pairs = pages.select("key", "side", "page_num", text).filter("words <> ''").groupBy("key").agg(own("a"), own("b"))
    sides = [f"transform({s}, x -> x.{c}) AS {s}_{c}" for s in "ab" for c in ("words", "page_num")]

    def side(texts: list[str], nums: list[int]) -> tuple[list[str], list[int]]:
        words = [t.split(" ") for t in texts]
        return [w for page in words for w in page], [n for n, page in zip(nums, words, strict=True) for _ in page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            columns = [batch.column(c) for c in ("a_words", "a_page_num", "b_words", "b_page_num")]
            for r in range(batch.num_rows):
                (a, page_a), (b, page_b) = side(columns[0][r].as_py(), columns[1][r].as_py()), side(columns[2][r].as_py(), columns[3][r].as_py())
                at = [(0, 0), *cut(a, b), (len(a), len(b))]
                for n, ((s, t), (u, v)) in enumerate(zip(at, at[1:], strict=False)):
                    rows += runs_of(n, a[s:u], b[t:v], page_a[s:u], page_b[t:v], most)
                take += [r] * (len(rows) - len(take))
                if len(rows) >= 1 << 16 or r == batch.num_rows - 1:
                    cols = list(zip(*rows, strict=True)) or [()] * 7
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, RUN_TYPES, strict=True))], RUN_COLUMNS)
                    take, rows = [], []

    return pairs.selectExpr("key", *sides).mapInArrow(run, f"key {dict(pages.dtypes)['key']}, {RUNS}")


def diff(pages: DataFrame, most: int = EDITS) -> DataFrame:
    """key, segment, i, kind, page_a, page_b, n_words, words: runs of words in order of (segment, i); a run of one kind may go
    on in the next segment. page_a and page_b are those on which a run begins, null on the side that lacks it.

    pages(key, side, page_num, content) with side a or b; a version without words has no pages here, and a pair without any
    gives no rows. Blanks between words don't count. Empty tables give no rows."""
    size = pages.groupBy("key").agg(F.sum(F.length("content")).alias("n"))
    long = written(size.filter(F.col("n") > WHOLE).select("key"), "long")
    short = whole(pages.join(long, "key", "left_anti"), most)
    return short if long.isEmpty() else short.unionByName(by_words(pages.join(long, "key", "left_semi"), most))


def by_words(pages: DataFrame, most: int) -> DataFrame:
    """`diff` of pairs of any size: no task holds the words of a pair."""
    every = words(pages)
    order = Window.partitionBy("key", "side").orderBy("place")
    marked = every.join(anchors(every).withColumn("hit", F.lit(1)), ["key", "side", "place"], "left")
    placed = marked.withColumn("segment", F.coalesce(F.sum("hit").over(order), F.lit(0)))
    own = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("place", "word", "page_num")))).alias(s)
    segments = placed.groupBy("key", "segment").agg(own("a"), own("b"))
    sides = [f"transform({s}, x -> x.{c}) AS {s}_{c}" for s in "ab" for c in ("word", "page_num")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for r, x in enumerate(batch.select(["segment", "a_word", "a_page_num", "b_word", "b_page_num"]).to_pylist()):
                rows += runs_of(x["segment"], x["a_word"], x["b_word"], x["a_page_num"], x["b_page_num"], most)
                take += [r] * (len(rows) - len(take))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, RUN_TYPES, strict=True))], RUN_COLUMNS)

    return segments.selectExpr("key", "segment", *sides).mapInArrow(run, f"key {dict(pages.dtypes)['key']}, {RUNS}")


def statistics(runs: DataFrame) -> DataFrame:
    """key, additions, removals, unchanged (words), pages_touched (numbers on either side of pages where a change begins)."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_words"))), F.lit(0)).alias
    touched = F.when(F.col("kind") != "unchanged", F.coalesce("page_a", "page_b"))
    return runs.groupBy("key").agg(n("added")("additions"), n("removed")("removals"), n("unchanged")("unchanged"), F.array_sort(F.collect_set(touched)).alias("pages_touched"))


def rebuilt(runs: DataFrame) -> DataFrame:
    """key, a, b: both versions' words, a blank between, from the runs alone."""
    text = lambda without: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != without, F.struct("segment", "i", "words")))), lambda x: x["words"]), " ")
    return runs.groupBy("key").agg(text("added").alias("a"), text("removed").alias("b"))
