"""Bundles of documents and differences between versions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.strings import stripped

HEAD, GAP = 500, 2
# What the first page of a document may say.
BOUNDARY = [
    "--- document", "--- page 1 ---", "document 1", "exhibit a", "attachment", "annex", "schedule", "invoice", "purchase order", "delivery note", "bill of lading", "loan application", "credit agreement",
    "deed of", "form no", "form no.", "application no", "reference no", "gst invoice", "tax invoice", "proforma invoice", "salary slip", "payslip", "pay slip", "bank statement", "account statement",
]


def starts(text: Column, signals: list[str] = BOUNDARY) -> Column:
    head = F.lower(F.substring(text, 1, HEAD))
    return reduce(lambda a, s: a | F.contains(head, F.lit(s)), [*signals, "page 1 of", "page 1\n"], F.lit(False))


def boundaries(pages: DataFrame, signals: list[str] = BOUNDARY) -> DataFrame:
    """doc_id, starts: page numbers where a document begins. The first page does, and a page that says so if it is GAP
    pages or more after the last one taken, which makes it a fold and no window."""
    marked = pages.select("doc_id", F.struct("page_num", starts(F.col("content"), signals).alias("hit")).alias("p"))
    grouped = marked.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    first = F.array(F.get("ps", F.lit(0))["page_num"])
    fold = F.aggregate("ps", first, lambda a, p: F.when(p["hit"] & (p["page_num"] - F.element_at(a, -1) >= GAP), F.concat(a, F.array(p["page_num"]))).otherwise(a))
    return grouped.select("doc_id", fold.alias("starts"))


def parts(pages: DataFrame, signals: list[str] = BOUNDARY) -> DataFrame:
    """doc_id, part, start, stop (exclusive, null for the last), preview_stop, n_pages, content of each part."""
    cut = boundaries(pages, signals).select("doc_id", F.posexplode("starts").alias("i", "start"))
    w = Window.partitionBy("doc_id").orderBy("start")
    ranges = cut.withColumn("stop", F.lead("start").over(w)).withColumn("part", F.col("i") + 1).drop("i")
    inside = pages.join(ranges, "doc_id").filter((F.col("page_num") >= F.col("start")) & (F.col("stop").isNull() | (F.col("page_num") < F.col("stop"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "content"))), lambda x: x["content"]), "\n\n")
    return inside.groupBy("doc_id", "part", "start", "stop").agg(F.count("*").alias("n_pages"), text.alias("content"))


def offsets(pages: DataFrame) -> DataFrame:
    """Where each page begins in its document's text, a separator between pages."""
    w = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)))


def normalised(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"\s+", " "))


def word_delta(pairs: DataFrame) -> DataFrame:
    """key, added, removed: words that one side has more of, with repetition. pairs(key, a, b)."""
    word = lambda c, n: pairs.select("key", F.explode(F.filter(F.split(normalised(F.col(c)), " "), lambda w: w != "")).alias("word"), F.lit(n).alias("n"))
    net = word("a", -1).union(word("b", 1)).groupBy("key", "word").agg(F.sum("n").alias("n"))
    return net.groupBy("key").agg(F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


SEGMENTS = "key long, i int, kind string, words string"


def diff(pairs: DataFrame) -> DataFrame:
    """key, i, kind (unchanged, removed, added), words: runs by longest matching blocks; a replaced run is removed, then
    added. pairs(key, a, b)."""

    def run(batches: Iterator) -> Iterator:  # noqa: ANN401
        import difflib

        import pandas as pd

        for b in batches:
            out = []
            for key, x, y in zip(b["key"], b["a"], b["b"], strict=True):
                p, q = (x or "").split(), (y or "").split()
                rows = []
                for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
                    if op == "equal":
                        rows.append(("unchanged", p[i1:i2]))
                    else:
                        rows += [(k, w) for k, w in (("removed", p[i1:i2]), ("added", q[j1:j2])) if w]
                out += [(key, i, k, " ".join(w)) for i, (k, w) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["key", "i", "kind", "words"])

    return pairs.select("key", "a", "b").mapInPandas(run, SEGMENTS)
