"""Fill-in-the-middle: texts cut in three and put in another order, by overlapping chunks.

Whether a unit (a code point, a word, a line) begins at a byte depends on that byte and the one before it alone. So the
bytes of a text are taken in chunks that overlap by one byte, and all chunks of all texts of a batch count the units that
begin in them side by side; sums of the counts before a chunk route the two cut ranks of a text to the chunks that own
them, and only those are scanned again for the place. A cut costs two scans of one chunk beyond the count, no text is
decoded, and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import flat, slices

#: Bytes of a chunk.
CHUNK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are cut, and of these that have the suffix in front.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: For bytes and the bytes before them, where a unit begins; the first byte of a text always begins one.
Begins = Callable[[np.ndarray, np.ndarray], np.ndarray]
UNITS: dict[str, Begins] = {
    "char": lambda before, byte: (byte & 0xC0) != 0x80,
    "word": lambda before, byte: SPACE[before] & ~SPACE[byte],
    "line": lambda before, byte: before == 10,
}


def begun(data: np.ndarray, at: np.ndarray, begins: Begins, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of all texts start (and all end), how many units begin before each within its text, and the number
    of chunks before each text. data holds the texts one after the other, at where they start."""
    n = -(-np.diff(at) // chunk)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start = at[:-1][text] + (np.arange(first[-1]) - first[text]) * chunk
    count = np.zeros(len(start) + 1, np.int64)
    if len(start):
        new = np.concatenate([[True], begins(data[:-1], data[1:])])
        new[at[:-1][n > 0]] = True
        count[1:] = np.cumsum(np.add.reduceat(new, start, dtype=np.int64))
    return np.append(start, at[-1]), count, first


def place(data: np.ndarray, at: np.ndarray, row: int, rank: int, begins: Begins, chunks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """The byte at which the unit of that rank begins in a text, from its owning chunk; the text's end for the rank after all."""
    start, count, first = chunks
    lo, hi = first[row], first[row + 1]
    owner = int(np.searchsorted(count[lo : hi + 1], count[lo] + rank, side="right")) + lo - 1
    if owner >= hi:
        return int(at[row + 1])
    s, e = int(start[owner]), min(int(start[owner + 1]), int(at[row + 1]))
    new = begins(data[s - 1 : e - 1], data[s:e]) if s > at[row] else np.concatenate([[True], begins(data[s : e - 1], data[s + 1 : e])])
    return s + int(np.flatnonzero(new)[count[lo] + rank - count[owner]])


def ranks(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits for a document, from the sha256 of seed:id; a null id is an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "char", id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, output of every document.

    psm is <P>prefix<S>suffix<M>middle and spm <S>suffix<P>prefix<M>middle; plain texts (those that are empty or null, hold
    a mark, or fall outside the share that is cut) stay as they are and have no units of parts. Rows that repeat are cut
    alike; an empty table gives no rows; other columns are not read."""
    begins = UNITS[unit]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = flat(b.column("text"))
            chunks = begun(data, at, begins)
            count, first = chunks[1:]
            n = count[first[1:]] - count[first[:-1]]
            h = [b.column(f"h{i}").to_numpy() for i in range(4)]
            cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            form, prefix, middle, out = [], [], [], []
            for i in range(b.num_rows):
                text = data[at[i] : at[i + 1]].tobytes()
                if not text or h[2][i] % 100 >= cut or any(m in text for m in marks):
                    form.append("plain"), prefix.append(None), middle.append(None), out.append(text)
                    continue
                p, q = (place(data, at, i, int(r), begins, chunks) - int(at[i]) for r in cuts[:, i])
                head, mid, tail = text[:p], text[p:q], text[q:]
                spm = h[3][i] % 100 < suffix_first
                parts = (marks[1], tail, marks[0], head) if spm else (marks[0], head, marks[1], tail)
                form.append("spm" if spm else "psm"), prefix.append(int(cuts[0, i])), middle.append(int(cuts[1, i] - cuts[0, i]))
                out.append(b"".join([*parts, marks[2], mid]))
            cols = [b.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    numbers = [c.alias(f"h{i}") for i, c in enumerate(ranks(F.col(id_col), seed))]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *numbers)
    return read.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark can begin inside a part and end in a true mark, so a split finds just these."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


#: DuckDB SQL of what op12 returns.
SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
