"""Sentence-aware chunks: flat, or parents with children. Sizes count words between white space, or code points."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

SIZE, OVERLAP = 512, 64
PARENT, CHILD = 2000, 400
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
CHUNKS = "doc_id long, page_num int, chunk_id string, level string, parent_id string, n int, content string"


def measured(text: str, unit: str) -> int:
    return len(text.split()) if unit == "token" else len(text)


def pieces(text: str, size: int, unit: str) -> list[str]:
    """Sentences; one longer than `size` is cut at its words, or at code points."""
    out = []
    for s in filter(None, map(str.strip, SENTENCE.split(text))):
        if measured(s, unit) <= size:
            out.append(s)
        elif unit == "token":
            words = s.split()
            out += [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        else:
            out += [s[i : i + size] for i in range(0, len(s), size)]
    return out


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, unit: str = "token") -> list[str]:
    """Runs of sentences of at most `size`; a run starts with the last sentences of the one before, up to `overlap`."""
    out: list[str] = []
    parts = pieces(text, size, unit)
    gap = 0 if unit == "token" else 1  # pieces are joined by a blank
    sizes = [measured(s, unit) + gap for s in parts]
    first, held = 0, 0  # where the open run starts, and its size with a gap behind each piece
    for i, m in enumerate(sizes):
        if i and held + m - gap > size:
            out.append(" ".join(parts[first:i]))
            first, held = i, 0
            while first and held + sizes[first - 1] - gap <= overlap and held + sizes[first - 1] + m - gap <= size:
                first -= 1
                held += sizes[first]
        held += m
    return [*out, " ".join(parts[first:])] if parts else out


def hierarchy(text: str, parent: int = PARENT, child: int = CHILD, unit: str = "token") -> list[tuple[str, list[str]]]:
    """Parents with their children; children no smaller than parents give flat chunks, parents of themselves."""
    if child >= parent:
        return [(c, []) for c in split(text, parent, min(200, parent // 10), unit)]
    return [(p, split(p, child, min(50, child // 8), unit)) for p in split(text, parent, min(200, parent // 10), unit)]


def chunked(pages: DataFrame, mode: str = "flat", unit: str = "token", **sizes: int) -> DataFrame:
    """Chunks of pages(doc_id, page_num, content). Parents carry no parent_id, children that of their parent; ids are
    digests of place and content, so a rerun gives the same. Blank and null pages give none."""

    def run(batches: Iterator) -> Iterator:  # noqa: ANN401
        import pandas as pd

        for b in batches:
            rows = []
            for doc, page, text in zip(b["doc_id"], b["page_num"], b["content"], strict=True):
                name = lambda *x: hashlib.sha256("|".join(map(str, (doc, page, *x))).encode()).hexdigest()  # noqa: B023, E731
                text = (text or "").replace("\0", " ").strip()
                if mode == "flat":
                    rows += [(doc, page, name("flat", i, c), "flat", None, i, c) for i, c in enumerate(split(text, unit=unit, **sizes))]
                    continue
                for i, (p, children) in enumerate(hierarchy(text, unit=unit, **sizes)):
                    key = name("parent", i, p)
                    rows.append((doc, page, key, "parent" if children else "flat", None, i, p))
                    rows += [(doc, page, name("child", i, j, c), "child", key, j, c) for j, c in enumerate(children)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNKS.split(", ")])

    return pages.select("doc_id", "page_num", "content").mapInPandas(run, CHUNKS)
