"""Free-text dates and durations on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (strict pattern, format) in the order in which they are tried.
DAY = r"(0?[1-9]|[12][0-9]|3[01])"
MONTH = r"(0?[1-9]|1[0-2])"
RULE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMMM yyyy"),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMM yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}", "yyyy"),
]
ISO = RULE_FORMATS[0]
TAX_FORMATS = [ISO, (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy")]
LOOSE_FORMATS = [*RULE_FORMATS[:6], (r"\d{4}-\d{1,2}", "yyyy-M"), (r"\d{1,2}/\d{4}", "M/yyyy"), (r"[A-Za-z]+ \d{4}", "MMMM yyyy"), (r"\d{4}", "yyyy")]
CHECK_FORMATS = [*RULE_FORMATS[:6], RULE_FORMATS[9]]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parsed(text: Column, formats: list[tuple[str, str]] = RULE_FORMATS) -> Column:
    """The first format that fits, as a date; null if none does."""
    return F.coalesce(iso(F.trim(text)), any_of(text, formats)) if ISO in formats else any_of(text, formats)


def iso(text: Column) -> Column:
    """yyyy-M-d by a cast: what its format gives, without a formatter and the case of letters."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), text.try_cast("date"))


def any_of(text: Column, formats: list[tuple[str, str]]) -> Column:
    return once(F.initcap(F.trim(text)), lambda s: F.coalesce(*(F.when(s.rlike(f"^{p}$"), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for p, f in formats)))


def month_year(text: Column) -> Column:
    """Sept'25, May 2024: the first of that month; two digits are of this century."""
    pattern = r"^([A-Za-z]{3,9})[\s'’]*,?\s*(\d{2}|\d{4})$"
    s = F.trim(text)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(s, pattern, 1), 1, 3)))
    year = F.expr("0") + F.regexp_extract(s, pattern, 2).try_cast("int")
    return F.when(s.rlike(pattern) & (month > 0), F.make_date(F.when(year < 100, year + 2000).otherwise(year), month.cast("int"), F.lit(1)))


def loose(text: Column) -> Column:
    rest = (month_year(text), any_of(text, LOOSE_FORMATS), parsed(F.translate(text, "'’", "  "), LOOSE_FORMATS))
    return F.coalesce(iso(F.trim(text)), *rest)


def months(start: Column, end: Column) -> Column:
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.day(end) < F.day(start), 1).otherwise(0)
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0)))


def once(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once for a row: what a fold over no items starts from, and ends with. Unlike an item
    of a list, it isn't copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def duration(start: Column, end: Column, as_of: Column) -> Column:
    """1y 9m between two free-text dates; up to as_of where the end can't be read, null where the start can't."""

    def written(n: Column) -> Column:
        years, rest = F.floor(n / 12), n % 12
        y = F.when(years > 0, F.concat(years.cast("string"), F.lit("y")))
        m = F.when((rest > 0) | (years == 0), F.concat(rest.cast("string"), F.lit("m")))
        return F.when(n.isNotNull(), F.concat_ws(" ", y, m))

    dates = F.struct(loose(start).alias("s"), F.coalesce(loose(end), as_of).alias("e"))
    return once(dates, lambda p: once(months(p["s"], p["e"]), written))
