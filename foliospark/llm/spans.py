"""Spans that detectors of secrets and of personal data report, and how documents are masked with them."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices, texts

SPANS = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"


class Span(NamedTuple):
    """[start, end) in code points."""

    kind: str
    start: int
    end: int


def ordered(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, kinds.index(s.kind), s.end))


def outside(spans: Iterable[Span], base: list[Span]) -> list[Span]:
    """Those that no base span covers: of the base spans that start no later, the furthest end tells."""
    by_start = sorted((b.start, b.end) for b in base)
    starts, reach = [s for s, _ in by_start], [-1, *accumulate((e for _, e in by_start), max)]
    return [s for s in spans if reach[bisect_right(starts, s.start)] < s.end]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with <kind> for each span; of overlapping spans the first one names the whole."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s.start, -s.end))
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i].start < max(end, start + 1):
            end = max(end, spans[i].end)
            i += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


#: For a batch of texts, the base spans and the added spans of each.
Detector = Callable[[pa.Array], list[tuple[list[Span], list[Span]]]]


def digest(docs: DataFrame, detect: Callable[[], Detector], base: list[str], kinds: list[str], id_col: str, text_col: str) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans. Null and empty texts have none, rows that repeat
    are read each, an empty table gives no rows, and other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = detect()
        for b in slices(batches, "text"):
            found = find(b.column("text"))
            counts = [pa.array([sum(s.kind == k for s in x) for x, _ in found], pa.int64()) for k in base]
            sha = [hashlib.sha256(spelled(ordered(x, kinds)).encode()).hexdigest() for x, _ in found]
            every = [spelled(ordered([*x, *y], kinds)) for x, y in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string")


def listed(docs: DataFrame, detect: Callable[[], Detector], kinds: list[str], id_col: str, text_col: str) -> DataFrame:
    """The spans themselves, base and added; nulls, empty and repeated rows as in `digest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = detect()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches, "text"):
            found = find(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([[s._asdict() for s in ordered(x[i], kinds)] for x in found], kind) for i in (0, 1))], ["doc_id", "base", "added"])

    return texts(docs, id_col, text_col).mapInArrow(run, SPANS)


def redact(docs: DataFrame, detect: Callable[[], Detector], text_col: str) -> DataFrame:
    """docs with its spans masked; a null text stays null, all other columns stay."""

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        find, out = detect(), []
        for b in slices(iter([pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"])]), "text"):
            plain = b.column("text").fill_null("")
            for text, null, (x, y) in zip(plain.to_pylist(), b.column("text").is_null().to_pylist(), find(plain), strict=True):
                out.append(None if null else masked(text, [*x, *y]) if x or y else text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, mask(F.col(text_col)))
