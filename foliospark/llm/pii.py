"""Personal data: base patterns, and names and addresses by a linear-chain conditional random field.

The field sees, for a word and its two neighbours, the word's shape and, if the small labelled table has it, the word
itself. It is trained on that table, by maximum likelihood. Its scores depend on single words, so a batch of texts is
scored through the dictionary of its words, and Viterbi runs over all sentences of the batch side by side."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliospark.llm import spans as sp
from foliospark.llm.common import flat
from foliospark.llm.spans import Span

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "person", "address"]
TAGS = ["O", "B-person", "I-person", "B-address", "I-address"]
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Which texts have anything to look at; a superset, by an engine of linear time.
MAYBE = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"([0-9][ -]?){11}[0-9]", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}

#: The labelled table: a sentence a line, {person: ...} and {address: ...} around what is to be found.
LABELLED = """
My name is {person: Anna Keller} and I live in the city.
Please contact {person: John Smith} for details.
Dear {person: Maria Lopez}, thank you for your letter.
Mr. {person: Peter Novak} will call you tomorrow.
Mrs. {person: Helen Brown} signed the form.
Dr. {person: Ahmed Hassan} sees patients on Monday.
Signed by {person: Laura Rossi} on behalf of the board.
Her name is {person: Emily Clark}.
His name is {person: David O'Brien}.
The patient, {person: Susan Wright}, was seen today.
Regards, {person: Thomas Meyer}
Ms. {person: Julia Schmidt} moved away last year.
Attn: {person: Robert Jones}
Customer name: {person: Linda M. Davis}
Contact {person: Paul Martin} at the desk.
Dear Dr. {person: Nina Petrova}, we write to you again.
I spoke with Mr. {person: Carlos Garcia} about it.
Ask {person: Sarah Miller} or {person: James Wilson} about the key.
Employee: {person: Kevin Lee}
Prof. {person: Irene Costa} teaches here.
She lives at {address: 12 Oak Street} with her family.
Ship it to {address: 221 Baker Street} before noon.
Our office is at {address: 45 Maple Avenue} near the park.
Address: {address: 7 Hill Road}
He moved to {address: 1600 Pine Lane} in May.
Send mail to {address: 98 North Elm Drive} please.
Home address: {address: 350 Fifth Avenue}
{person: Mark Evans} lives at {address: 19 King Street} now.
Deliver to {person: Olga Ivanova}, {address: 23 Lake Boulevard}
The meeting is at {address: 5 Market Square} today.
The house stood on the hill.
It was a long day and we went home.
There are 12 apples and 30 pears in the box.
In the end the work was done.
This License applies to the Software.
Licensed under the Apache License, Version 2.0.
All rights reserved.
Released under the MIT License.
Walking along the shore and back was all.
Rain was on the roof of it.
And then it is by the water.
Der Tag war lang und die Nacht kalt.
Die Stadt und das Haus sind alt.
La casa es grande y el sol brilla.
Les enfants et la mer sont ici.
Man ist hier auf dem Weg.
Nobody came to the end of that.
We paid 100 dollars for the street lamp.
The road was closed for 3 days.
My name is not on the list.
Contact us for more details.
Dear customer, thank you for your order.
New users may call the office at any time.
The Apache License and the GNU General Public License are free.
Version 2 of the Street Map is out.
On Monday the North Road was closed.
Call us on Monday or Friday in May.
Breaking: The Big Day Is Here
Table | Chair | Lamp | Desk
Note: this is only a test.
Nothing moved. Silence fell over us.
Price$$$ up%%% now*** for### All&&& Sale%%% Ends,### soon.
Big*** Sale%%% Today&&& Only.### Buy*** 12### Get%%% More&&&
Home | About us | Terms | Help page | Log in | Search
See [1] and (2) or http://site/path?x=1 for more == and -- that.
A_b = c_d + 4 * e; F(x) -> {y}
Is Here not There? It Was Then. That Is All.
"""
CLOSING = ".,;:!?)]}\"'"
OPENING = "([{\"'"
PLAIN = re.compile(r"[a-z]+ \Z").match
ABBREVIATED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Attn|[A-Z])\.\Z")


def shape(word: str) -> str:
    """Letters as X or x, digits as d, all but .'- as ?; a repeat of one kind counts once."""
    out = ""
    for c in word:  # of any length; a word is looked at once a batch
        k = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c if c in ".'-" else "?"
        if out[-1:] != k:
            out += k
    return out


def stripped(chunk: str) -> tuple[int, int]:
    """Where the word of a chunk starts and ends, without the punctuation around it."""
    start, end = 0, len(chunk.rstrip())
    while start < end and chunk[start] in OPENING:
        start += 1
    word = chunk[start:end]
    if not ABBREVIATED.match(word):
        while end > start and chunk[end - 1] in CLOSING:
            end -= 1
    return start, end


def closes(chunk: str) -> bool:
    """A sentence ends with this chunk: a word and the white space after it."""
    word = chunk.rstrip()
    return "\n" in chunk[len(word) :] or word.endswith((".", "!", "?")) and not ABBREVIATED.match(word)


class Field:
    """The trained field: three scores by tag for each known shape and word, as itself, as the one before, and as the
    one after; scores of tag pairs; scores of the first tag."""

    def __init__(self, shapes: dict[str, int], words: dict[str, int], score: np.ndarray, turn: np.ndarray, first: np.ndarray):
        self.shapes, self.words, self.score, self.turn, self.first = shapes, words, score, turn, first

    def rows(self, chunk: str) -> tuple[int, int, bool]:
        """Rows of score for a chunk's shape and word; unknown ones share the first row of each."""
        if PLAIN(chunk):
            word = chunk[:-1]
            return self.shapes.get("x", 0), self.words.get(word, len(self.shapes) + 1), False
        start, end = stripped(chunk)
        word = chunk[start:end]
        return self.shapes.get(shape(word), 0), self.words.get(word, len(self.shapes) + 1), closes(chunk)


def sentence(line: str) -> tuple[list[str], list[int]]:
    """Chunks of a labelled line and their tags."""
    chunks, tags = [], []
    for m in re.finditer(r"\{(\w+): ([^}]*)\}(\S*)|\S+", line):
        words = f"{m[2]}{m[3]}".split() if m[1] else [m[0]]
        chunks += [w + " " for w in words]
        tags += [TAGS.index(("I-" if i else "B-") + m[1]) if m[1] else 0 for i in range(len(words))]
    return chunks, tags


@functools.lru_cache(maxsize=1)
def trained(table: str = LABELLED, steps: int = 120, rate: float = 0.25, decay: float = 0.004) -> Field:
    """Gradient descent with momentum on the regularised likelihood: the same field in every process."""
    lines = [sentence(x) for x in table.strip().split("\n")]
    # a word that the table has but once says little beside its shape
    seen: dict[str, int] = {}
    for chunks, _ in lines:
        for c in chunks:
            s, e = stripped(c)
            seen[c[s:e]] = seen.get(c[s:e], 0) + 1
    shapes = {x: i + 1 for i, x in enumerate(sorted({shape(c[slice(*stripped(c))]) for chunks, _ in lines for c in chunks}))}
    words = {x: i for i, x in enumerate(sorted(w for w, n in seen.items() if n > 1), len(shapes) + 2)}
    n, k = len(shapes) + 2 + len(words), len(TAGS)
    field = Field(shapes, words, np.zeros((3, n, k)), np.zeros((k, k)), np.zeros(k))
    params = [field.score, field.turn, field.first]
    speed = [np.zeros_like(p) for p in params]
    coded = [(np.array([field.rows(c)[:2] for c in chunks]), np.array(tags)) for chunks, tags in lines]
    for _ in range(steps):
        grad = [np.zeros_like(p) for p in params]
        for rows, tags in coded:
            e = emissions(field.score, rows)
            e[0] += field.first
            a = [e[0]]
            for t in range(1, len(e)):
                a.append(e[t] + np.logaddexp.reduce(a[-1][:, None] + field.turn, axis=0))
            b = [np.zeros(k)]
            for t in range(len(e) - 1, 0, -1):
                b.append(np.logaddexp.reduce(field.turn + e[t] + b[-1], axis=1))
            b = b[::-1]
            whole = np.logaddexp.reduce(a[-1])
            p = np.exp(np.array(a) + np.array(b) - whole)
            diff = -p
            diff[np.arange(len(tags)), tags] += 1
            for side, shift in ((0, 0), (1, 1), (2, -1)):
                d = diff[max(0, shift) : len(diff) + min(0, shift)]
                r = rows[max(0, -shift) : len(rows) + min(0, -shift)]
                np.add.at(grad[0][side], r[:, 0], d)
                np.add.at(grad[0][side], r[:, 1], d)
            grad[2] += diff[0]
            for t in range(1, len(e)):
                grad[1] -= np.exp(a[t - 1][:, None] + field.turn + e[t] + b[t] - whole)
                grad[1][tags[t - 1], tags[t]] += 1
        for p, v, g in zip(params, speed, grad, strict=True):
            v *= 0.9
            v += rate * (g / len(coded) - decay * p)
            p += v
    field.turn[:, 2] += np.array([-1e4, 0, 0, -1e4, -1e4])  # I- follows its own kind only
    field.turn[:, 4] += np.array([-1e4, -1e4, -1e4, 0, 0])
    field.first[[2, 4]] -= 1e4
    return field


def emissions(score: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores by tag of each word of one sentence."""
    own, before, after = (score[i][rows[:, 0]] + score[i][rows[:, 1]] for i in range(3))
    own[1:] += before[:-1]
    own[:-1] += after[1:]
    return own


def viterbi(e: np.ndarray, begin: np.ndarray, sizes: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Best tags of all sentences: sentence i has rows begin[i] to begin[i] + sizes[i] of e."""
    order = np.argsort(-sizes, kind="stable")
    start, size = begin[order], sizes[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")  # sentences of t + 1 words or more
    back = np.zeros(e.shape, np.int8)
    best = e[start].copy()
    for t in range(1, len(alive)):
        n = alive[t]
        at = start[:n] + t
        reach = best[:n, :, None] + turn
        back[at] = reach.argmax(1)
        best[:n] = reach.max(1) + e[at]
    tags = np.zeros(len(e), np.int8)
    last = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        tags[at] = last[:n]
        if t:
            last[:n] = back[at, last[:n]]
    return tags


class Reader:
    """Names and addresses in batches of texts."""

    def __init__(self, field: Field):
        self.field = field

    def find(self, array: pa.Array) -> list[list[Span]]:
        data, at = flat(array)
        out: list[list[Span]] = [[] for _ in range(len(array))]
        if not len(data):
            return out
        white = data <= 0x20
        start = ~white & np.append(True, white[:-1])
        firsts = at[:-1][np.diff(at) > 0]
        start[firsts] = True  # white space before the first word is a word of no letters
        begin = np.flatnonzero(start)
        ends = np.append(begin, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        rows = np.array([self.field.rows(c.decode("utf-8", "replace")) for c in distinct], np.int64)
        score = self.field.score.astype(np.float32)
        own, before, after = (score[i][rows[:, 0]] + score[i][rows[:, 1]] for i in range(3))
        new = np.append(True, rows[which[:-1], 2] > 0)
        new[np.searchsorted(begin, firsts)] = True
        head = np.flatnonzero(new)
        e = own[which]
        inner = np.flatnonzero(~new)
        e[inner] += before[which[inner - 1]]
        e[inner - 1] += after[which[inner]]
        e[head] += self.field.first.astype(np.float32)
        turn = self.field.turn.astype(np.float32)
        # a word outside O loses its lead and gains from two tag pairs at most: sentences of greater leads are all O
        sure = e[:, 0] - e[:, 1:].max(1) >= 2 * (turn.max() - turn[0, 0])
        open_ = np.flatnonzero(~np.logical_and.reduceat(sure, head))
        size = np.diff(np.append(head, len(e)))
        tags = viterbi(e, head[open_], size[open_], turn)
        hits = np.flatnonzero(tags)
        if not len(hits):
            return out
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        opens = hits[tags[hits] % 2 == 1]
        for i in opens.tolist():
            j = i + 1
            while j < len(tags) and tags[j] == tags[i] + 1 and not new[j]:
                j += 1
            doc = int(np.searchsorted(at, begin[i], side="right")) - 1
            base = int(points[at[doc]])
            s, _ = stripped(distinct[which[i]].decode("utf-8", "replace"))
            _, e2 = stripped(distinct[which[j - 1]].decode("utf-8", "replace"))
            a, z = int(points[begin[i]]) - base + s, int(points[begin[j - 1]]) - base + e2
            if z > a:
                out[doc].append(Span(TAGS[tags[i]][2:], a, z))
        return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """By the @ signs, so that long runs of letters cost their length only."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append(Span("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str, email: bool = True, ip: bool = True, card: bool = True, phone: bool = True) -> list[Span]:
    out = emails(text) if email else []
    if ip:
        out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for on, kind, pattern, least, most in ((card, "card", CARD, 12, 19), (phone, "phone", PHONE, 9, 15)):
        for m in pattern.finditer(text) if on else ():
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append(Span(kind, *m.span()))
    return out


def detector(field: Field | None = None) -> sp.Detector:
    reader = Reader(field or trained())

    def find(array: pa.Array) -> list[tuple[list[Span], list[Span]]]:
        maybe = zip(*(pc.match_substring_regex(array, p).to_pylist() for p in MAYBE.values()), strict=True)
        more = reader.find(array)
        base = [base_spans(array[i].as_py(), *flags) if any(flags) else [] for i, flags in enumerate(maybe)]
        return [(b, sp.outside(m, b)) for b, m in zip(base, more, strict=True)]

    return find


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digest of each document. Null and empty texts have no spans; rows that repeat stay; an empty table
    gives no rows; other columns are not read."""
    field = trained()
    return sp.digest(docs, lambda: detector(field), BASE, KINDS, id_col, text_col)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans themselves, base and added, of each document; null and empty texts have none, as in `find`."""
    field = trained()
    return sp.listed(docs, lambda: detector(field), KINDS, id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with <kind> in place of personal data. Null texts stay null and empty ones empty; rows that repeat stay; an
    empty table gives no rows; all other columns stay."""
    field = trained()
    return sp.redact(docs, lambda: detector(field), text_col)
