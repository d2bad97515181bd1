"""Byte-level BPE: encoding with character offsets, and decoding that copes with characters split over tokens."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from array import array as packed
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliospark.llm.chunks import ChunkCodec
from foliospark.llm.common import flat, slices, spread, texts

ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
DECODED = "doc_id long, bytes binary, text string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A pre-token longer than this counts as one whose merges may overlap.
SHORT = 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(x) for _, x in sorted([*((b, b) for b in own), *((b, 0x100 + i) for i, b in enumerate(rest))])]


class ByteBpe:
    """A rank file run by the tokenizers library.

    Every split of a ranked token into two ranked tokens is a merge, in the order of ranks. That equals merging by the
    rank of the joined bytes but where two merges to one token overlap, which takes an immediately repeated substring;
    such pre-tokens are checked against the rank library, and its ids hold."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        shown = byte_characters()
        self.table = {b: c for b, c in enumerate(shown) if chr(b) != c}
        self.space = shown[0x20]
        self.read = {c: b for b, c in enumerate(shown)}
        write = lambda x: x.decode("latin-1").translate(self.table)
        vocab, merges = {}, []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            vocab[write(token)] = rank
            merges += [(write(token[:i]), write(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.tokenizer = Tokenizer(BPE(vocab, merges, ignore_merges=True))
        self.pieces = regex.compile(pattern).findall
        self.checked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for shown_token, i in vocab.items():  # the reversed byte table
            tokens[i] = bytes(self.read[c] for c in shown_token)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.codec = ChunkCodec(self.chunk_ids)

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        plain = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        pieces: list[str] = []
        counts: list[int] = []
        for c in chunks:
            text = c.decode("utf-8", "replace")
            if plain(text):
                pieces.append(text)
                counts.append(1)
            else:
                found = self.pieces(text)
                pieces += found
                counts.append(len(found))
        distinct = list(dict.fromkeys(pieces))
        known = dict(zip(distinct, self.piece_ids(distinct), strict=True))
        done = [known[p] for p in pieces]
        out, at = [], 0
        for n in counts:
            out.append(done[at] if n == 1 else b"".join(done[at : at + n]))
            at += n
        return out

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        shown = [p.replace(" ", self.space) if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.table) for p in pieces]
        done = [packed("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(shown, add_special_tokens=False)]
        twice = re.compile(r"(.+)\1", re.S).search
        for i, p in enumerate(pieces):
            if len(p) > SHORT or len(done[i]) > 8 and twice(p):
                done[i] = packed("I", self.checked._encode_single_piece(p.encode("utf-8"))).tobytes()
        return done

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.codec.ids(*flat(array))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each text's start."""
        sizes = self.sizes[ids]
        return self.pool[spread(self.starts[ids], sizes)], np.append(0, np.cumsum(sizes))[at]

    def offsets(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the first code point that it has a byte of, and the one after its last; split characters count in
        every token that holds a part of them. Relative to its text."""
        sizes = self.sizes[ids]
        data = self.pool[spread(self.starts[ids], sizes)]
        point = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        end = np.cumsum(sizes)
        base = np.repeat(point[np.append(0, end)[at[:-1]]], np.diff(at))
        return point[end - sizes + 1] - 1 - base, point[end] - base


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path, pattern)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids of each text with code-point offsets [starts, ends). Null and empty texts give empty lists; rows that repeat
    stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches, "text"):
            ids, at = bpe.encode(b.column("text"))
            starts, ends = bpe.offsets(ids, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(_lists(x, at) for x in (ids, starts, ends))], ["doc_id", "ids", "starts", "ends"])

    return texts(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """bytes and text of `ids`. Null and empty lists give empty ones; rows that repeat stay; an empty table gives no rows;
    other columns are not read. A text that ends or begins inside a character has U+FFFD there; its bytes are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches, "ids"):
            lists = b.column("ids")
            at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            data, to = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            parts = [data[to[i] : to[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(parts, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in parts], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass, as digests: no ids travel. Null and empty texts have 0 tokens and the digest of
    nothing; rows that repeat stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in slices(batches, "text"):
            ids, at = bpe.encode(b.column("text"))
            data, to = bpe.decode(ids, at)
            hexes = [[hashlib.sha256(x[k[i] : k[i + 1]]).hexdigest() for i in range(b.num_rows)] for x, k in ((np.ascontiguousarray(ids, "<u4"), at), (data, to))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), *map(pa.array, hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, DIGEST)
