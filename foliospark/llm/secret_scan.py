"""Assignment-aware secret scan: a lexer of source and configuration text, and names that reach literals.

Beside the base patterns, a lexer reads strings, names with members and string subscripts, signs of assignment, type
annotations, flags and tags, and gives pairs of a name and its value: literals, other names, and both joined by `+` or
standing side by side. Calls and members that nothing assigns are no literals, and what stands in a string is not read as
source. Names are constants, wherever they are assigned: a literal is scored by the most sensitive name that it reaches
through any number of them, and by its own make-up, together with what it is joined to."""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliospark.llm import spans as sp
from foliospark.llm.spans import Span

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "literal"]
# The base patterns.
ASSIGN = re.compile(r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: No name without one of these says anything.
SENSITIVE_TEXT = r"(?i)(pass|pwd|secret|token|key|credential|bearer|auth)"
#: Which texts have anything to look at; a superset, by an engine of linear time.
MAYBE = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "pair": r"[A-Za-z0-9_\"'\])][ \t]*(=|:)|--[A-Za-z]|</[A-Za-z_]", "sensitive": SENSITIVE_TEXT}
STRING = re.compile(r"""(?:(?<![A-Za-z0-9_])[rbufRBUF]{1,2})?(?:(\"{3}|'{3})((?:\\[\s\S]|(?!\1)[^\\])*+)\1|(["'`])((?:\\.|(?!\3)[^\\\n])*+)\3)""")
PLAIN_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+"
NAME = re.compile(rf"{PLAIN_NAME}(?:(?:[.-]|->|::){PLAIN_NAME})*+")
BRACED = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*+)\}")
TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:[ \t][^<>\n]*+)?>[ \t]*+([^<>\s][^<>\n]*+)</\1>")
FLAG = re.compile(r"(?<![A-Za-z0-9_-])--([A-Za-z][A-Za-z0-9_-]*+)(?:=|[ \t]++(?!-))")
#: What the lexer stops at outside values; all else is passed over.
TOKEN = re.compile(rf"""(?P<flag>{FLAG.pattern})|(?P<name>{NAME.pattern})|(?P<quote>(?<![A-Za-z0-9_])["'`])|(?P<open><(?=[A-Za-z_]))|(?P<sign>[:=!<>+*/%&|^-]+)|(?P<key>\[[ \t]*+["'])""")
SIGNS = ("=", ":", ":=", "=>")
BLANK = re.compile(r"[ \t]*+")
BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>]++""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a word of a name says.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "passcode": 3.0, "secret": 3.0, "token": 2.5, "apikey": 2.5, "credential": 2.5, "credentials": 2.5, "bearer": 2.0, "auth": 1.5}
#: Words that make a `key` sensitive.
KEYED = {"api", "private", "access", "secret", "signing", "encryption", "auth", "service", "master"}
PLACEHOLDER = re.compile(r"(?i)(?:change_?me|your[_-].*|example.*|x+|\*+|\.+|null|none|nil|true|false|todo|tbd|test|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})\Z")
#: A literal counts from this score on.
LEAST = 5.0


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    return max([SENSITIVE.get(w, 0.0) for w in words] + [2.5 if "key" in words and KEYED & set(words) else 0.0])


def made_of(characters: Counter) -> float:
    """Length, kinds of characters and entropy; prose scores low."""
    n = characters.total()
    if n < 6:
        return -9.0
    entropy = -sum(k / n * math.log2(k / n) for k in characters.values())
    kinds = sum(any(map(f, characters)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return (n >= 8) + (kinds >= 2) + (entropy >= 3) - 2.0 * any(map(str.isspace, characters))


Part = tuple[str, int, int]
"""("literal", start, end) or ("name", start, end)."""


class Pair(NamedTuple):
    """A name, as written with its subscripts, and what is assigned to it: literals and names that are joined."""

    name: str
    parts: list[Part]


def _string(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of a string's content, and the end of the string."""
    m = STRING.match(text, at)
    return m and (*(m.span(2) if m[1] else m.span(4)), m.end())


def _value(text: str, at: int) -> tuple[list[Part], int]:
    """The parts of the value that starts at `at`, and where it ends."""
    parts: list[Part] = []
    while True:
        at = BLANK.match(text, at).end()
        if found := _string(text, at):
            parts.append(("literal", found[0], found[1]))
            at = found[2]
        elif m := BRACED.match(text, at):
            parts.append(("name", *m.span(1)))
            at = m.end()
        elif m := BARE.match(text, at):
            word = m[0].rstrip(".,:")
            name = NAME.match(text, at + (word[:1] == "$"))
            if name and name.end() == at + len(word) and not any(c.isdigit() for c in word):
                after = BLANK.match(text, name.end()).end()
                if text[after : after + 1] in ("(", "["):
                    return [], name.end()  # a call or a member of something
                parts.append(("name", *name.span()))
                if text[after : after + 1] in ("=", ":"):
                    return parts, at  # assigned in turn
                at = name.end()
            elif name and text[name.end() : name.end() + 1] in ("(", "["):
                return [], name.end()
            elif parts:
                return parts, at
            else:
                # a name with digits is a constant where one is assigned, and else a value of its own
                both = ("either", at, at + len(word)) if name and name.end() == at + len(word) else ("literal", at, at + len(word))
                parts.append(both)
                at += len(word)
        else:
            return parts, at
        after = BLANK.match(text, at).end()
        if text[after : after + 1] == "+":
            at = after + 1
            while at < len(text) and text[at] in " \t\r\n\\":
                at += 1
        elif not (text[after : after + 1] in ("\"", "'") and parts[-1][0] == "literal" and _string(text, after)):
            return parts, at


def _annotated(text: str, at: int) -> int | None:
    """The end of the sign after a type that starts at `at`, if one stands there."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in " \t|.*?" or depth and c == ",":
            at += 1
        elif c == "[":
            depth, at = depth + 1, at + 1
        elif c == "]":
            depth, at = depth - 1, at + 1
        elif m := NAME.match(text, at):
            at = m.end()
        else:
            return at + 1 if c == "=" and text[at + 1 : at + 2] != "=" and depth == 0 else None
    return None


def pairs(text: str) -> list[Pair]:
    """Names and their values in the order of the text."""
    out: list[Pair] = []
    at, last, ends = 0, "", -1  # the name or string before, and where it ends

    def assign(name: str, start: int) -> int:
        parts, end = _value(text, start)
        if parts:
            out.append(Pair(name, parts))
        return max(end, start)

    while m := TOKEN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if m["flag"]:
            at = assign(m["flag"].strip(" \t-="), m.end())
        elif m["name"]:
            last, ends = m["name"], m.end()
        elif m["quote"]:
            if found := _string(text, m.start()):
                last, ends, at = text[found[0] : found[1]], found[2], found[2]
        elif m["open"]:
            if tag := TAG.match(text, m.start()):
                out.append(Pair(tag[1], [("literal", tag.start(2), tag.start(2) + len(tag[2].rstrip()))]))
                at = tag.end()
        elif m["key"]:
            found = _string(text, m.end() - 1)
            close = BLANK.match(text, found[2]).end() if found else 0
            if found and text[close : close + 1] == "]":
                last = f"{last if ends == m.start() else ''}.{text[found[0]:found[1]]}"
                ends = at = close + 1
        elif kind == "sign" and m["sign"] in SIGNS and ends >= 0 and BLANK.match(text, ends).end() == m.start():
            start = (m["sign"] == ":" and _annotated(text, m.end())) or m.end()
            at = assign(last, start)
            ends = -1
    return out


def literals(text: str) -> list[Span]:
    """Literals that score as secrets, with constants carried from name to name, in the order of the text."""
    found = pairs(text)
    where: dict[str, list[int]] = {}
    for i, p in enumerate(found):
        where.setdefault(p.name, []).append(i)

    def resolved(name: str, before: int) -> int | None:
        """The pair that gives a name its value: the last one before, or else the first one after."""
        places = where.get(name, [])
        k = bisect_left(places, before)
        return places[k - 1] if k else next((i for i in places[k:] if i != before), None)

    @functools.cache
    def own(i: int) -> tuple[list[tuple[int, int]], Counter]:
        """A pair's own literals but placeholders, and their characters."""
        at = [(a, z) for kind, a, z in found[i].parts if kind == "literal" or kind == "either" and resolved(text[a:z], i) is None]
        at = [(a, z) for a, z in at if not PLACEHOLDER.match(text, a, z)]
        return at, sum((Counter(text[a:z]) for a, z in at), Counter())

    scores = [name_score(p.name) for p in found]
    reached: dict[tuple[int, int], tuple[float, float]] = {}
    seen: set[int] = set()
    for first in sorted((i for i, s in enumerate(scores) if s), key=lambda i: -scores[i]):  # the most sensitive names first
        open_ = [(first, -9.0)]
        while open_:
            i, joined = open_.pop()
            if i in seen:
                continue
            seen.add(i)
            whole, others = Counter(), []
            for kind, start, end in found[i].parts:
                to = resolved(text[start:end], i) if kind != "literal" else None
                if to is not None:
                    others.append(to)
                    whole += own(to)[1]
            spans_, mine = own(i)
            joined = max(joined, made_of(whole + mine), made_of(mine))
            open_ += [(to, joined) for to in others]
            reached.update((at, (scores[first], joined)) for at in spans_)
    return [Span("literal", *at) for at, (name, made) in sorted(reached.items()) if name + made >= LEAST]


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[Span]:
    out = []
    if assign:
        out += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        out += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def detector() -> sp.Detector:
    def find(array: pa.Array) -> list[tuple[list[Span], list[Span]]]:
        maybe = [pc.match_substring_regex(array, p).to_pylist() for p in MAYBE.values()]
        out = []
        for i, flags in enumerate(zip(*maybe, strict=True)):
            if not any(flags[:3]) and not all(flags[3:]):
                out.append(([], []))
                continue
            text = array[i].as_py()
            base = base_spans(text, *flags[:3])
            out.append((base, sp.outside(literals(text), base) if flags[3] and flags[4] else []))
        return out

    return find


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digest of each document. Null and empty texts have no spans; rows that repeat stay; an empty table
    gives no rows; other columns are not read."""
    return sp.digest(docs, detector, BASE, KINDS, id_col, text_col)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans themselves, base and added, of each document; null and empty texts have none, as in `scan`."""
    return sp.listed(docs, detector, KINDS, id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with <kind> in place of each secret. Null texts stay null and empty ones empty; rows that repeat stay; an empty
    table gives no rows; all other columns stay."""
    return sp.redact(docs, detector, text_col)
