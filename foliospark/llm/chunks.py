"""Texts as runs of chunks that tokenise independently, each distinct chunk encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from foliospark.llm.common import spread

#: Most distinct chunks that a worker remembers between batches; then it starts afresh. Bounds memory, never results.
REMEMBERED = 300_000


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks start: at texts, at a lone space or line feed between visible characters, and where an ASCII letter or
    digit meets one of `.,;:`. There the pre-tokenisers of both vocabularies always end a piece, whatever stands around.
    Visible are here ASCII, and U+00C0 to U+02FF, whose first bytes are C3 to CB; other neighbours make longer chunks."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    start = np.zeros(n, bool)
    if n > 2:
        seen = (data > 0x20) & (data < 0x7F)
        latin = (data >= 0xC3) & (data <= 0xCB)
        after = seen.copy()
        after[1:] |= latin[:-1]
        low = data | 0x20
        word = ((low >= 0x61) & (low <= 0x7A)) | ((data >= 0x30) & (data <= 0x39))
        mid = data[1:-1]
        start[1:-1] = ((mid == 0x20) | (mid == 0x0A)) & after[:-2] & (seen | latin)[2:]
        start[1:] |= word[:-1] & ((data[1:] == 0x2E) | (data[1:] == 0x2C) | (data[1:] == 0x3B) | (data[1:] == 0x3A))
    first = at[:-1]
    start[first[first < n]] = True
    return np.flatnonzero(start)


class ChunkCodec:
    """Encodes batches of texts through a dictionary of their chunks.

    encode: distinct chunks (bytes) to their ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.known = encode, remembered, {}

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's start (texts + 1 numbers)."""
        begin = cuts(data, at)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.append(begin, len(data)).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        fresh = [x for x in distinct if x not in self.known]
        if len(self.known) + len(fresh) > self.remembered:
            self.known, fresh = {}, distinct
        self.known.update(zip(fresh, self.encode(fresh), strict=True))
        parts = [self.known[x] for x in distinct]
        if len(self.known) > self.remembered:
            self.known = {}
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        lengths = sizes[which]
        out = pool[spread((np.cumsum(sizes) - sizes)[which], lengths)]
        total = np.append(0, np.cumsum(lengths))
        return out, total[np.searchsorted(begin, at, side="left")]
