"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings, whether they occur in the whole text. For each labelled sentence that
names a group, every identity term is swapped for others of its kind, and the squared change of the score is part of the
loss: a neutral mention of one group must not score above that of another. Only the bounded sample of labelled rows meets
on the driver; scoring runs over all texts through the dictionary of their words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import flat, slices, spread, texts

#: About as many labelled rows are learnt from, dealt by a hash of doc_id; more are not.
SAMPLE = 10_000
#: Most features that a model may keep, and occurrences that each needs in the sample.
FEATURES, OCCURRENCES = 4096, 4
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: Weight of the counterfactual term, of the absolute weights, and steps of the descent.
FAIRNESS, SPARSE, STEPS = 1.0, 2e-4, 400
#: Log odds of every text where nothing can be learnt: a score of 0.25.
UNTOLD = -float(np.log(3))
# Identity terms by kind. Terms of one line stand for each other.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "citizens", "foreigners", "natives"],
    ["old", "young", "elderly"],
    ["disabled", "deaf", "blind"],
]
SWAPS = {term: [x for x in line if x != term] for line in IDENTITY for term in line}
WORD = re.compile(r"\w+")
SCORES = "doc_id long, score double, predicted int"


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace"))


def word_features(word: str) -> list[int]:
    """The word itself and its beginnings, as 32-bit hashes."""
    return [hashed("=" + word), *(hashed("^" + word[:n]) for n in BEGINNINGS if len(word) >= n)]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is never learnt from; one without an id is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def dictionary(array: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Chunks between ASCII white space: the row of each, its place in the dictionary, and the dictionary."""
    data, at = flat(array)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    white = data <= 0x20
    start = ~white & np.append(True, white[:-1])
    start[at[:-1][np.diff(at) > 0]] = True
    begin = np.flatnonzero(start)
    ends = np.append(begin, len(data)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.searchsorted(at, begin, side="right") - 1, coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, array: pa.Array) -> np.ndarray:
        """Of each text between 0 and 1. A feature counts once in a text, wherever it stands."""
        row, which, chunks = dictionary(array)
        place = {int(f): i for i, f in enumerate(self.features)}
        hit: list[list[int]] = []
        for c in chunks:
            words = WORD.findall(c.decode("utf-8", "replace").lower())
            hit.append([place[f] for w in words for f in word_features(w) if f in place])
        counts = np.fromiter(map(len, hit), np.int64, len(hit))
        busy = np.flatnonzero(counts[which]) if len(which) else which
        starts = np.cumsum(counts) - counts
        pool = np.array([x for h in hit for x in h], np.int64)
        n = counts[which[busy]]
        found = pool[spread(starts[which[busy]], n)] if len(busy) else pool[:0]
        once = np.unique(np.repeat(row[busy], n) * len(self.features) + found) if len(found) else found
        z = np.bincount(once // max(1, len(self.features)), weights=self.weights[once % max(1, len(self.features))], minlength=len(array))[: len(array)] if len(once) else np.zeros(len(array))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def text_features(text: str) -> tuple[set[int], list[set[int]]]:
    """Features of a text, and of its counterfactuals: the k-th swaps every identity term for the k-th other."""
    words = list(dict.fromkeys(WORD.findall(text.lower())))
    base = {f for w in words for f in word_features(w)}
    named = [w for w in words if w in SWAPS]
    plain = {f for w in words if w not in SWAPS for f in word_features(w)} if named else base
    return base, [plain | {f for w in named for f in word_features(SWAPS[w][k % len(SWAPS[w])])} for k in range(max((len(SWAPS[w]) for w in named), default=0))]


def select(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The features that tell the labels apart best, by the G statistic; ties go to the smaller hash."""
    if not rows:
        return np.zeros(0, np.uint32)
    every, both = np.unique(np.concatenate([f for _, f in rows]), return_counts=True)
    able = np.flatnonzero(both >= OCCURRENCES)
    every, both = every[able], both[able]
    pos = np.zeros(len(every), np.int64)
    for y, f in rows:  # row by row: only the counts are held for all of the sample
        if y:
            at = np.minimum(np.searchsorted(every, f), len(every) - 1) if len(every) else f[:0]
            pos[at[every[at] == f]] += 1
    n, n1 = len(rows), sum(y for y, _ in rows)
    gain = np.zeros(len(every))
    for a, b in ((pos, n1), (both - pos, n - n1)):
        expected = both * b / n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(a > 0, a * np.log(a / expected), 0)
            gain += np.where(b - a > 0, (b - a) * np.log((b - a) / np.maximum(b - expected, 1e-9)), 0)
    able = np.flatnonzero(gain > 6)
    best = able[np.lexsort((every[able], -gain[able]))][:FEATURES]
    own = np.array(sorted({f for t in SWAPS for f in word_features(t)}), np.uint32)
    return np.unique(np.concatenate([every[best], own[np.isin(own, every)]]))


def fit(rows: list[tuple[int, np.ndarray, list[np.ndarray]]]) -> Model:
    """Proximal descent with momentum on logistic loss, fairness term and absolute weights."""
    features = select([(y, f) for y, f, _ in rows])
    y = np.array([r[0] for r in rows], float)
    if not len(features) or y.min() == y.max():  # nothing tells the labels apart, so nothing is rejected
        return Model(features[:0], np.zeros(0), UNTOLD)

    def sparse(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [np.searchsorted(features, f) for f in lists]
        at = [a[(a < len(features)) & (features[np.minimum(a, len(features) - 1)] == f)] for a, f in zip(at, lists, strict=True)]
        return np.repeat(np.arange(len(lists)), [len(a) for a in at]), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)

    r, c = sparse([x[1] for x in rows])
    pairs = [(x[1], alt) for x in rows for alt in x[2]]
    (ra, ca), (rb, cb) = sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    n, k = len(rows), len(features)
    # both classes weigh alike in half of the loss
    weight = 0.5 / n + 0.25 * np.where(y == 1, 1 / y.sum(), 1 / (n - y.sum()))
    w, bias, v, vb, last, last_b = np.zeros(k), 0.0, np.zeros(k), 0.0, np.zeros(k), 0.0
    # the curvature is at most a quarter of the mean squared norm of rows, bounded by power iteration
    u = np.ones(k) / np.sqrt(k)
    for _ in range(20):
        q = weight * np.bincount(r, weights=u[c], minlength=n)
        u = np.bincount(c, weights=q[r], minlength=k)
        top = np.linalg.norm(u)
        u /= max(top, 1e-12)
    rate = 1 / (0.25 * (top + weight.sum()) * 1.2 + 8 * FAIRNESS)  if pairs else 1 / (0.25 * (top + weight.sum()) * 1.2)
    for t in range(STEPS):
        m = t / (t + 3)
        v, vb = w + m * (w - last), bias + m * (bias - last_b)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=v[c], minlength=n) + vb, -30, 30)))
        g = weight * (p - y)
        grad = np.bincount(c, weights=g[r], minlength=k)
        if pairs:
            d = (np.bincount(ra, weights=v[ca], minlength=len(pairs)) - np.bincount(rb, weights=v[cb], minlength=len(pairs))) * (2 * FAIRNESS / len(pairs))
            grad += np.bincount(ca, weights=d[ra], minlength=k) - np.bincount(cb, weights=d[rb], minlength=k)
        last, last_b = w, bias
        w = v - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE, 0)
        bias = vb - rate * g.sum()
    used = np.flatnonzero(w)
    return Model(features[used], w[used], float(bias))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows that aren't held out: all, or about `sample` of them by a hash of doc_id; of a doc_id that
    many rows share, with different texts, about as many again by a hash of the text. At most about two samples are held.

    Rows without a label, doc_id or text don't count; a doc_id with both labels is learnt as both, and rows that repeat
    once. Without labels of both kinds the model scores every text 0.25."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()

    def about(df: DataFrame, n: int, *by: str) -> DataFrame:
        part = min(1.0, sample / max(1, n))
        return df if part == 1.0 else df.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 62)) < int(part * (1 << 62)))

    part = about(known, known.count(), "doc_id")
    # at most about `sample` rows, so broadcasting them is bounded
    named = texts(docs.filter(F.col("text").isNotNull())).join(F.broadcast(part), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("name"))
    rows = named.count()
    chosen = (named if rows <= 2 * sample else about(named, rows, "doc_id", "name")).dropDuplicates(["doc_id", "toxic", "name"]).drop("name")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            base, alts = [], []
            for x in b.column("text").to_pylist():
                own, other = text_features(x)
                base.append(np.array(sorted(own), "<u4").tobytes())
                alts.append([np.array(sorted(o), "<u4").tobytes() for o in other])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(base, pa.binary()), pa.array(alts, pa.list_(pa.binary()))], ["doc_id", "toxic", "base", "alts"])

    got = chosen.mapInArrow(features, "doc_id long, toxic int, base binary, alts array<binary>").toArrow().to_pylist()
    read = lambda x: np.frombuffer(x, "<u4")
    got.sort(key=lambda x: (x["doc_id"], x["toxic"], x["base"]))
    return fit([(x["toxic"], read(x["base"]), [read(a) for a in x["alts"]]) for x in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score and predicted of each text. Null and empty texts get the score of no features; rows that repeat stay; an
    empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, SCORES)


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; null and empty texts have the score of no features; rows that repeat
    go or stay together; an empty table gives no rows; all columns stay."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(b.column("text")) for b in slices(iter([batch]), "text"))]))

    return docs.filter(of(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
