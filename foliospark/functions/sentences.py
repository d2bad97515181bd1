"""Sentence-aware chunks as column functions, without Python workers: the same chunks as `operators.chunk.split`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.entities import let
from foliospark.operators.chunk import CHILD, OVERLAP, PARENT, SIZE
from foliospark.sources.content import SPACE, trimmed

STATE = "struct<first:int,held:array<int>,sum:int,fresh:boolean,out:array<struct<first:int,n:int>>>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]++"), lambda w: w != "")


def pieces(text: Column, size: int, unit: str) -> Column:
    """Array of text and m, its size: sentences, of which one longer than `size` is cut at its words, or at code points."""
    sentences = F.filter(F.transform(F.split(text, f"(?<=[.!?])[{SPACE}]+|\n+"), trimmed), lambda s: s != "")

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.slice(w, i * size + 1, size))

    def cut(s: Column) -> Column:
        if unit == "token":
            whole = lambda w: F.array(F.struct(s.alias("text"), F.size(w).alias("m")))
            return let(words(s), lambda w: F.when(F.size(w) <= size, whole(w)).otherwise(F.transform(runs(w), lambda r: F.struct(F.array_join(r, " ").alias("text"), F.size(r).alias("m")))))
        parts = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        return F.transform(parts, lambda p: F.struct(p.alias("text"), F.length(p).alias("m")))

    return F.flatten(F.transform(sentences, cut))


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, unit: str = "token") -> Column:
    """Array of texts: runs of pieces of at most `size`; a run starts with the last pieces of the one before, up to `overlap`.

    The fold's state is the open run's first piece, the sizes of its pieces, whose number `size` bounds, and their sum, and the
    runs that are done as first piece and number. Null gives null, a text without sentences an empty array.
    """
    gap = 0 if unit == "token" else 1

    def tail(held: Column, m: Column) -> Column:
        """n and sum of the longest end of an open run that the next one may start with."""
        most = F.least(F.lit(overlap + gap), size - m)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("fits"))

        def more(a: Column, x: Column) -> Column:
            fits = a["fits"] & (a["sum"] + x + gap <= most)
            return F.struct(F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, a["sum"] + x + gap).otherwise(a["sum"]).alias("sum"), fits.alias("fits"))

        return F.aggregate(F.reverse(held), start, more)

    def closed(s: Column, m: Column) -> Column:
        done = F.array_append(s["out"], F.struct(s["first"].alias("first"), F.size(s["held"]).alias("n")))
        count = F.size(s["held"])

        def begun(t: Column) -> Column:
            kept = F.slice(s["held"], count - t["n"] + 1, t["n"])
            return F.struct((s["first"] + count - t["n"]).alias("first"), F.array_append(kept, m).alias("held"), (t["sum"] + m + gap).alias("sum"), F.lit(True).alias("fresh"), done.alias("out"))

        return let(tail(s["held"], m), begun)

    def step(s: Column, p: Column) -> Column:
        m = p["m"]
        opened = F.struct(s["first"].alias("first"), F.array_append(s["held"], m).alias("held"), (s["sum"] + m + gap).alias("sum"), F.lit(True).alias("fresh"), s["out"].alias("out"))
        return F.when(s["fresh"] & (s["sum"] + m > size), closed(s, m).cast(STATE)).otherwise(opened.cast(STATE))

    begin = F.struct(F.lit(0).alias("first"), F.array().cast("array<int>").alias("held"), F.lit(0).alias("sum"), F.lit(False).alias("fresh"), F.array().cast("array<struct<first:int,n:int>>").alias("out")).cast(STATE)
    last = lambda s: F.when(s["fresh"], F.array_append(s["out"], F.struct(s["first"].alias("first"), F.size(s["held"]).alias("n")))).otherwise(s["out"])

    def joined(p: Column) -> Column:
        return F.transform(F.aggregate(p, begin, step, last), lambda r: F.array_join(F.transform(F.slice(p, r["first"] + 1, r["n"]), lambda x: x["text"]), " "))

    return let(pieces(text, size, unit), joined)


def family(text: Column, parent: int = PARENT, child: int = CHILD, unit: str = "token") -> Column:
    """Array of parent, a text, and children, an array of texts; none where children would be no smaller than parents."""
    parents = chunks(text, parent, min(200, parent // 10), unit)
    none = F.array().cast("array<string>")
    inside = (lambda p: chunks(p, child, min(50, child // 8), unit)) if child < parent else lambda p: none
    return F.transform(parents, lambda p: F.struct(p.alias("parent"), inside(p).alias("children")))
