"""Masking of personal data on columns: ordered patterns, numbered placeholders, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.entities import let

# Patterns in the order in which they claim text.
PATTERNS = [
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?<!\d)(?:\+91[\-\s]?|91[\-\s]?|0)?[6-9]\d{9}(?!\d)"),
    ("DOB", r"\b(0?[1-9]|[12][0-9]|3[01])[\/\-\.](0?[1-9]|1[0-2])[\/\-\.](19|20)\d{2}\b"),
]


def numbered(kind: str):  # noqa: ANN201
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), v.alias("value"))


def matches(text: Column) -> Column:
    """array of (kind, n, value): each pattern sees what the ones before it left."""

    def found(rest: Column, kinds: list[tuple[str, str]]) -> Column:
        (kind, pattern), *others = kinds
        own = F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), numbered(kind))
        return F.concat(own, let(F.regexp_replace(rest, pattern, " "), lambda r: found(r, others))) if others else own

    return found(text, list(PATTERNS))


def mapping(text: Column, user: Column) -> Column:
    """array of (placeholder, value, kind), one for each span found."""
    name = lambda m: F.concat(F.lit("__PII_"), user.cast("string"), F.lit("_"), m["kind"], F.lit("_"), m["n"].cast("string"), F.lit("__"))
    return F.transform(matches(text), lambda m: F.struct(name(m).alias("placeholder"), m["value"].alias("value"), m["kind"].alias("kind")))


def masked(text: Column, rows: Column) -> Column:
    """Every value by its placeholder, longer values first; of equal values the first row counts."""
    ordered = F.transform(F.array_sort(F.transform(rows, lambda r, i: F.struct((-F.length(r["value"])).alias("size"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    return F.aggregate(ordered, text, lambda t, r: F.replace(t, r["value"], r["placeholder"]))


def unmasked(text: Column, rows: Column) -> Column:
    return F.aggregate(rows, text, lambda t, r: F.replace(t, r["placeholder"], r["value"]))
