"""Field scoring and business rules: each rule gives an array of results, a ruleset concatenates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import dates, money
from foliospark.functions.dates import once

# Words of a field name by type, in the order in which types are tried.
FIELD_TYPES = [
    ("email", ["email", "mail"]),
    ("phone", ["phone", "mobile", "contact", "tel"]),
    ("date", ["date", "dob", "birth", "expiry", "issued", "deadline"]),
    ("amount", ["amount", "salary", "price", "cost", "fee", "total", "balance", "ctc"]),
    ("url", ["url", "website", "linkedin", "link"]),
    ("list", ["skills", "experience", "education", "languages", "items"]),
]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# Texts that mean that nothing was found; the scorer ignores case, the rules don't.
SCORE_MISSING = ["", "null", "none", "n/a", "not found", "unknown"]
RULE_MISSING = ["", "null", "none", "n/a"]
TOLERANCE = 0.01


def field_type(name: Column) -> Column:
    words = F.split(F.lower(name), "_")
    out = F.lit("text")
    for kind, tokens in reversed(FIELD_TYPES):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, tokens))), kind).otherwise(out)
    return out


def named_type(name: str) -> str:
    """As field_type, of a name that is known when the plan is made."""
    words = name.lower().split("_")
    return next((kind for kind, tokens in FIELD_TYPES if set(words) & set(tokens)), "text")


FORMS = {
    "email": lambda x: x.rlike(EMAIL),
    "phone": lambda x: F.regexp_replace(x, r"[\s\-+()]", "").rlike(r"^[0-9]{7,15}$"),
    "date": lambda x: dates.parsed(x, dates.CHECK_FORMATS).isNotNull(),
    "amount": lambda x: money.score_amount(x).isNotNull(),
    "url": lambda x: x.rlike("^https?://"),
}


def well_formed(value: Column, kind: Column | str) -> Column:
    """True or false for typed fields, null for others."""
    if isinstance(kind, str):
        return FORMS[kind](value) if kind in FORMS else F.lit(None).cast("boolean")
    return reduce(lambda out, form: F.when(kind == form, FORMS[form](value)).otherwise(out), FORMS, F.lit(None).cast("boolean"))


def confidence(value: Column, kind: Column | str) -> Column:
    def scored(v: Column) -> Column:
        words = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
        text = once(words, lambda n: F.when(n >= 2, 0.85).when((n == 1) & (F.length(v) > 2), 0.7).otherwise(0.5))
        if isinstance(kind, str):  # a form is never null, so it is asked for once
            typed = F.when(FORMS[kind](v), 0.95).otherwise(0.4) if kind in FORMS else text
        else:
            typed = once(well_formed(v, kind), lambda x: F.when(x.isNull(), text).when(x, 0.95).otherwise(0.4))
        return F.when(F.lower(v).isin(SCORE_MISSING), 0.0).otherwise(typed)

    return F.when(value.isNull(), 0.0).otherwise(scored(F.trim(value)))


def found(score: Column) -> Column:
    return score >= 0.85


def status(score: Column) -> Column:
    return F.when(found(score), "FOUND").when(score >= 0.4, "LOW_CONFIDENCE").otherwise("NOT_FOUND")


def colour(label: Column) -> Column:
    return F.when(label == "FOUND", "green").when(label == "LOW_CONFIDENCE", "orange").when(label == "NOT_FOUND", "red").otherwise("gray")


def nested_confidence(items: Column, fields: list[str]) -> Column:
    """Score of a list of structs: the share of their values (texts) that are neither null nor empty; 0 without any.
    Two digits, ties to the even one."""
    filled = lambda i: reduce(lambda a, b: a + b, [F.when(i[f] != "", 1).otherwise(0) for f in fields])
    n = F.aggregate(items, F.lit(0), lambda a, i: a + filled(i))
    return F.when(F.size(items) > 0, F.bround(n / (F.size(items) * len(fields)), 2)).otherwise(0.0)


def scored_fields(texts: dict[str, Column], nested: dict[str, Column]) -> Column:
    """array of field, field_type, confidence, status, colour: texts by their own score, nested values by the score given."""

    def entry(name: str, score: Column) -> Column:
        label = status(score)
        return F.struct(F.lit(name).alias("field"), field_type(F.lit(name)).alias("field_type"), score.alias("confidence"), label.alias("status"), colour(label).alias("colour"))

    scores = [(name, confidence(value, field_type(F.lit(name)))) for name, value in texts.items()] + list(nested.items())
    return F.array(*(entry(name, score) for name, score in scores))


def overall(fields: Column) -> list[Column]:
    """Of an array of scored fields: the mean score, its status, and how many were found."""
    n = F.size(fields)
    mean = F.when(n > 0, F.bround(F.aggregate(fields, F.lit(0.0), lambda a, f: a + f["confidence"]) / n, 2)).otherwise(0.0)
    some = F.size(F.filter(fields, lambda f: f["status"] == "FOUND"))
    return [mean.alias("overall_confidence"), status(mean).alias("overall_status"), some.cast("long").alias("found_count"), n.alias("total_count")]


def result(field: str, code: str, state: Column, severity: str = "ERROR", blocking: bool = True) -> Column:
    """One result; a null state means that the rule doesn't apply, and is dropped by `rules`."""
    return once(state, lambda s: F.struct(
        F.lit(field).alias("field"), F.lit(code).alias("rule_code"), s.alias("status"),
        F.when(s == "FAIL", severity).when(s == "WARNING", "WARNING").otherwise("INFO").alias("severity"), ((s == "FAIL") & F.lit(blocking)).alias("blocking"),
    ))


def passed(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def sum_rule(items: Column, total: Column, field: str, blocking: bool = True) -> Column:
    """Parsed item amounts add up to the total; nothing to say without any."""
    known = F.filter(F.transform(items, money.rule_amount), lambda x: x.isNotNull())
    added = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    state = lambda p: F.when((F.size(p["k"]) > 0) & p["t"].isNotNull(), passed(F.abs(added(p["k"]) - p["t"]) <= TOLERANCE))
    return result(field, "VAL_101", once(F.struct(known.alias("k"), money.rule_amount(total).alias("t")), state), blocking=blocking)


def total_rule(subtotal: Column, tax: Column, total: Column) -> Column:
    state = lambda a: F.when(a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull(), passed(F.abs(a[0] + a[1] - a[2]) <= TOLERANCE))
    return result("total_amount", "VAL_102", once(F.array(*map(money.rule_amount, (subtotal, tax, total))), state))


def gst_rule(cgst: Column, sgst: Column, igst: Column, total: Column) -> Column:
    def state(a: Column) -> Column:
        parts = F.coalesce(a[0], F.lit(0.0)) + F.coalesce(a[1], F.lit(0.0)) + F.coalesce(a[2], F.lit(0.0))
        return F.when(a[3].isNotNull() & (a[0].isNotNull() | a[2].isNotNull()), passed(F.abs(parts - a[3]) <= TOLERANCE))

    return result("total_tax", "VAL_103", once(F.array(*map(money.rule_amount, (cgst, sgst, igst, total))), state), "WARNING", False)


def positive_rule(value: Column, field: str, blocking: bool = True) -> Column:
    state = once(money.rule_amount(value), lambda v: F.when(v.isNull(), "WARNING").otherwise(passed(v > 0)))
    return result(field, "VAL_104", F.when(value.isNotNull(), state), blocking=blocking)


def order_rule(start: Column, end: Column, field: str, blocking: bool = True) -> Column:
    state = once(F.array(dates.parsed(start), dates.parsed(end)), lambda d: F.when(d[0].isNull() | d[1].isNull(), "WARNING").otherwise(passed(d[0] < d[1])))
    return result(field, "VAL_201", F.when(start.isNotNull() & end.isNotNull(), state), blocking=blocking)


def conditional_rule(condition: Column, wanted: str, needed: Column, field: str, blocking: bool = True) -> Column:
    on = F.lower(F.trim(condition)) == wanted
    return result(field, "VAL_202", F.when(on, passed(present(needed))), blocking=blocking)


def regex_rule(value: Column, pattern: str, field: str, blocking: bool = True) -> Column:
    return result(field, "VAL_203", F.when(value.isNotNull() & (value != ""), passed(value.rlike(f"(?i)^(?:{pattern})"))), blocking=blocking)


def past_rule(value: Column, as_of: Column, field: str) -> Column:
    state = once(dates.parsed(value), lambda d: F.when(d.isNull(), "WARNING").otherwise(passed(d <= as_of)))
    return result(field, "VAL_204", F.when(value.isNotNull(), state), "WARNING", False)


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.trim(value).isin(RULE_MISSING)


def required_rule(value: Column, field: str, blocking: bool = True) -> Column:
    return result(field, "VAL_301", passed(F.coalesce(present(value), F.lit(False))), blocking=blocking)


def list_rule(items: Column, field: str, blocking: bool = False) -> Column:
    return result(field, "VAL_302", passed(F.coalesce(F.size(items) > 0, F.lit(False))), "WARNING", blocking)


def length_rule(value: Column, least: int, field: str) -> Column:
    return result(field, "VAL_303", F.when(value.isNotNull(), passed(F.length(F.trim(value)) >= least)), "WARNING", False)


def rules(*results: Column) -> Column:
    """array of those results that apply."""
    return F.filter(F.array(*results), lambda r: r["status"].isNotNull())


def summed(df: DataFrame, key: str, results: str) -> DataFrame:
    """key, passed, failed, warnings, blocking, is_valid."""
    count = lambda f: F.size(F.filter(results, f)).cast("long")
    return df.select(
        key, count(lambda r: r["status"] == "PASS").alias("passed"), count(lambda r: r["status"] == "FAIL").alias("failed"),
        count(lambda r: r["status"] == "WARNING").alias("warnings"), count(lambda r: r["blocking"]).alias("blocking"), (count(lambda r: r["blocking"]) == 0).alias("is_valid"),
    )


def missing_keys(rows: Column) -> Column:
    """For an array of maps, the keys that each lacks and a sibling has."""
    every = F.array_distinct(F.flatten(F.transform(rows, F.map_keys)))
    return F.transform(rows, lambda r: F.array_sort(F.array_except(every, F.map_keys(r))))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
