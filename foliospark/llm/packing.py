"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are range-sorted by length, and so are gaps. In a superstep every document of a length looks for its successor,
the smallest gap that holds it; where more documents than gaps meet, the lower rank goes first; gaps shrink; the rest
looks again, and opens new sequences when no gap is left. Documents of one length, and sequences of one gap, are alike:
a superstep works on ranges of ranks, of which there are at most as many as lengths times gaps, however large the corpus
is. Executors number the documents and look their ranges up; the driver sees counts by length only."""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array as packed
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.chunks import ChunkCodec
from foliospark.llm.common import flat, numbered, partitions, slices, texts, written

LENGTH = 2048
#: Words that one call of the library encodes.
TOGETHER = 2000
#: The id that ends each document.
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Upper-case ASCII to lower case, as bytes.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class WordBpe:
    """The word-end BPE file of the tokenizers library, over distinct chunks. ASCII capitals are folded before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.whole = Tokenizer.from_file(path)
        # strings of special tokens in a text are these tokens to the library, and stand in raw text, before folding
        self.special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.codec = ChunkCodec(self.chunk_ids)

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Of words of lower-case letters that no normalisation changes: many in one text, told apart by their word ends."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            ids = np.array(self.words.encode_batch_fast([" ".join(words[i : i + TOGETHER])], add_special_tokens=False)[0].ids, "<u4")
            raw, to = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [raw[a:z] for a, z in zip([0, *to], to, strict=False)]
        return out

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        stripped = [c.decode("utf-8", "replace").lstrip(" \n") for c in chunks]
        distinct = list(dict.fromkeys(stripped))
        words, other = [c for c in distinct if plain(c)], [c for c in distinct if not plain(c)]
        known = dict(zip(words, self.word_ids(words), strict=True))
        coded = self.whole.encode_batch_fast(other, add_special_tokens=False)
        known.update(zip(other, (packed("I", e.ids).tobytes() for e in coded), strict=True))
        return [known[c] for c in stripped]

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = flat(array)
        ids, to = self.codec.ids(LOWER[data], at)
        odd = pc.match_substring_regex(array, self.special, ignore_case=True).to_numpy(zero_copy_only=False) if self.special else ()
        if np.any(odd):  # such a text goes through the library whole
            parts = [np.array(self.whole.encode(array[i].as_py(), add_special_tokens=False).ids, np.uint32) if odd[i] else ids[to[i] : to[i + 1]] for i in range(len(array))]
            ids, to = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, to


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `length` where longer; ids as their CRC32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches, "text"):
            ids, at = bpe.encode(b.column("text"))
            ids = np.ascontiguousarray(np.insert(ids, at[1:], END), "<u4")
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            n = -(-sizes // length)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * length
            size = np.minimum(length, sizes[row] - start)
            begin = at[row] + start
            crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


class Placed(NamedTuple):
    """Documents of `size` with ranks from `rank` to `end`: `each` of them after the other in every sequence from
    `sequence` on, the first one at `offset`."""

    size: int
    rank: int
    end: int
    each: int
    sequence: int
    offset: int


def supersteps(counts: dict[int, int], length: int = LENGTH) -> list[Placed]:
    """Best fit, longest first, on ranges of equal documents and equal gaps."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, n = 0, counts[size]

        def fill(first: int, many: int, gap: int) -> None:
            """The next documents by rank go into sequences first, first + 1, ... of this gap."""
            nonlocal rank
            fit = gap // size
            full = min(many, (n - rank) // fit)
            rest = min(fit, n - rank - full * fit) if full < many else 0
            for k, each, begin in ((full, fit, first), (1 if rest else 0, rest, first + full)):
                if k:
                    placed.append(Placed(size, rank, rank + k * each, each, begin, length - gap))
                    rank += k * each
                    if left := gap - each * size:
                        gaps.setdefault(left, []).append((begin, k))
            if many > full + bool(rest):
                gaps.setdefault(gap, []).append((first + full + bool(rest), many - full - bool(rest)))

        for gap in sorted(g for g in gaps if g >= size):
            if rank == n:
                break
            for first, many in gaps.pop(gap):
                if rank < n:
                    fill(first, many, gap)
                else:
                    gaps.setdefault(gap, []).append((first, many))
        if rank < n:
            new = -(-(n - rank) // (length // size))
            fill(opened, new, length)
            opened += new
    return placed


def pack(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with its sequence and its place there.

    Null and empty texts are documents of the end id alone; rows that repeat are packed each; an empty table gives no
    rows; other columns are not read."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, length, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = np.array(sorted(supersteps(counts, length)), np.int64).reshape(-1, len(Placed._fields))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = numbered(cut, ["length"], order, "rank", partitions(spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = placed[:, 0] << 48 | placed[:, 1]
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            p = placed[np.searchsorted(keys, size << 48 | rank, side="right") - 1] if len(size) else placed[:0]
            nth = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p[:, 4] + nth // p[:, 3]), pa.array(p[:, 5] + nth % p[:, 3] * size)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
