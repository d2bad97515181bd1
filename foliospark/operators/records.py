"""Extracted records: checks of nested items, rulesets by document type, keys, chains of models, claims and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dates import duration, once
from foliospark.operators import validate as v

# Words of a sub-field's name that make it a start, an end, or a stated duration.
START = ["start", "from", "begin", "joined", "joining"]
END = ["end", "till", "until", "left", "relieving"]
DURATION, DURATION_PHRASES = ["duration", "tenure"], ["total_time", "time_spent"]
TEMPORAL = ["date", "string", "integer", "number", ""]


def date_pair(fields: list[dict]) -> dict:
    """start, end and duration: names of sub-fields by their words; empty without a start and an end. The last match of a
    kind counts; a duration is never an end."""
    found: dict[str, str | None] = {"start": None, "end": None, "duration": None}
    for f in fields:
        name, words = f["name"].lower(), set(f["name"].lower().split("_"))
        if any(p in name for p in DURATION_PHRASES) or words & set(DURATION):
            found["duration"] = f["name"]
        elif f.get("type", "").lower() in TEMPORAL:
            kind = "start" if words & set(START) else "end" if words & set(END) else None
            if kind:
                found[kind] = f["name"]
    return found if found["start"] and found["end"] else {}


def verified(items: Column, pair: dict, as_of: Column) -> Column:
    """Items with what their dates say: computed, stated, match (null unless both are there), backfilled; an empty stated
    duration takes the computed one."""

    def one(i: Column) -> Column:
        return once(duration(i[pair["start"]], i[pair["end"]], as_of), lambda computed: checked(i, computed))

    def checked(i: Column, computed: Column) -> Column:
        stated = F.nullif(i[pair["duration"]], F.lit("")) if pair.get("duration") else F.lit(None).cast("string")
        plain = lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit(""))
        filled = stated.isNull() & computed.isNotNull() & F.lit(bool(pair.get("duration")))
        check = F.struct(computed.alias("computed"), stated.alias("stated"), (plain(stated) == plain(computed)).alias("match"), filled.alias("backfilled"))
        out = i.withField("verification", check)
        return out.withField(pair["duration"], F.coalesce(stated, computed)) if pair.get("duration") else out

    return F.transform(items, one)


def incomplete(items: Column, fields: list[str]) -> Column:
    """For each item of a list, the sub-fields that it lacks though the list has them; null and empty lack."""
    lacks = lambda i: F.filter(F.array(*(F.when(i[f].isNull() | (i[f] == ""), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return F.transform(items, lacks)


def required(names: list[str], blocking: bool = True) -> Callable[[dict[str, Column]], list[Column]]:
    return lambda f: [v.required_rule(f[n], n, blocking) for n in names]


#: Rules by document type: each takes the record's columns by name (texts; lists as arrays of texts) and a date.
RULESETS: dict[str, Callable[[dict[str, Column], Column], list[Column]]] = {
    "invoice": lambda f, day: [
        *required(["vendor_name", "invoice_number", "invoice_date", "total_amount"])(f), v.list_rule(f["line_items"], "line_items"), v.sum_rule(f["line_items"], f["subtotal"], "subtotal"),
        v.total_rule(f["subtotal"], f["tax_amount"], f["total_amount"]), v.positive_rule(f["total_amount"], "total_amount"), v.past_rule(f["invoice_date"], day, "invoice_date"), v.order_rule(f["invoice_date"], f["due_date"], "due_date", False),
    ],
    "cv_resume": lambda f, _: [
        *required(["full_name", "email"])(f), *required(["current_title", "total_experience_years"], False)(f), v.regex_rule(f["email"], r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", "email", False),
        v.regex_rule(f["phone"], r"[\+\d\s\-\(\)]{7,20}$", "phone", False), v.list_rule(f["skills"], "skills"), v.length_rule(f["full_name"], 3, "full_name"), v.length_rule(f["education"], 10, "education"),
    ],
    "contract": lambda f, day: [
        *required(["party_1", "party_2", "effective_date", "agreement_type"])(f), v.past_rule(f["effective_date"], day, "effective_date"), v.order_rule(f["effective_date"], f["expiry_date"], "expiry_date"),
        v.list_rule(f["key_obligations"], "key_obligations"), v.length_rule(f["party_1"], 2, "party_1"), v.length_rule(f["party_2"], 2, "party_2"), v.length_rule(f["governing_law"], 3, "governing_law"),
    ],
    "bank_statement": lambda f, _: [
        *required(["account_holder", "bank_name", "statement_period"])(f), *required(["opening_balance", "closing_balance"], False)(f), v.length_rule(f["account_holder"], 3, "account_holder"), v.length_rule(f["statement_period"], 5, "statement_period"),
    ],
    "gst_return": lambda f, _: [
        *required(["gstin", "legal_name", "filing_period", "return_type"])(f), *required(["total_tax_liability"], False)(f), v.regex_rule(f["gstin"], r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$", "gstin"),
        v.gst_rule(f["cgst"], f["sgst"], f["igst"], f["total_tax_liability"]), v.positive_rule(f["taxable_turnover"], "taxable_turnover", False), v.positive_rule(f["total_tax_liability"], "total_tax_liability", False),
    ],
    "loan_application": lambda f, day: [
        *required(["applicant_name", "loan_type", "loan_amount_requested", "loan_tenure"])(f), *required(["annual_income", "employment_type"], False)(f), v.positive_rule(f["loan_amount_requested"], "loan_amount_requested"), v.positive_rule(f["annual_income"], "annual_income", False),
        v.conditional_rule(f["employment_type"], "salaried", f["employer_name"], "employer_name", False), v.past_rule(f["applicant_dob"], day, "applicant_dob"), v.length_rule(f["applicant_name"], 3, "applicant_name"),
    ],
}
# Other names of rulesets.
ALIASES = {"receipt": "invoice", "resume": "cv_resume", "cv": "cv_resume", "gstr-1": "gst_return", "gstr-3b": "gst_return", "agreement": "contract", "nda": "contract"}


class _Fields(dict):
    """Columns of a record; one that it lacks is null."""

    def __missing__(self, name: str) -> Column:
        return F.lit(None).cast("array<string>" if name in ("line_items", "skills", "key_obligations") else "string")


def judged(records: DataFrame, doc_type: str, key: str, as_of: Column) -> DataFrame:
    """key and results of a type's rules; an unknown type has none, and so is valid."""
    name = ALIASES.get(doc_type, doc_type)
    fields = _Fields({c: F.col(c) for c in records.columns})
    found = RULESETS[name](fields, as_of) if name in RULESETS else []
    kind = v.result("", "", F.lit("PASS"))
    return records.select(key, v.rules(*found).alias("results") if found else F.filter(F.array(kind), lambda _: F.lit(False)).alias("results"))


def key_state(status: Column, calls: Column, last_reset: Column, limit: Column, grace: Column, now: Column) -> Column:
    """What becomes of a call with an API key."""
    today = F.when(F.to_date(now) == last_reset, calls).otherwise(0)
    active = F.when(today >= limit, "rate limit").otherwise("valid")
    return F.when(status == "active", active).when(status == "rotating", F.when(now < grace, "valid_rotating").otherwise("expired")).otherwise("invalid")


def chain(text: Column, providers: list[str]) -> Column:
    """provider:model entries of a comma-separated chain, malformed and unknown ones left out, as structs."""
    entries = F.filter(F.transform(F.split(text, ","), lambda e: F.trim(e)), lambda e: F.contains(e, F.lit(":")))
    parts = F.transform(entries, lambda e: F.struct(F.lower(F.trim(F.substring_index(e, ":", 1))).alias("provider"), F.trim(F.regexp_extract(e, "^[^:]*:(.*)$", 1)).alias("model")))
    return F.filter(parts, lambda p: p["provider"].isin(providers))


def criterion(field: Column, skills: DataFrame | None, groups: list[tuple[str, list[str]]]) -> Column:
    """The criterion that a free-text field means: education, experience, or the first group that it names."""
    f = F.lower(field)
    out = F.lit(None).cast("string")
    for name, members in reversed(groups):
        hit = F.contains(f, F.lit(name.lower()))
        for m in members:
            hit = hit | F.contains(f, F.lit(m.lower()))
        out = F.when(hit, F.lit(f"skill:{name}")).otherwise(out)
    return F.when(F.contains(f, F.lit("educat")), "education").when(F.contains(f, F.lit("experience")), "experience").otherwise(out)


def without_claims(scores: DataFrame, n_criteria: int) -> DataFrame:
    """key, adjusted: the overall score less the mean loss of its adjusted criteria, for those that lose any.
    scores(key, overall, original, adjusted)."""
    lost = scores.groupBy("key").agg(F.first("overall").alias("overall"), F.sum(F.col("original") - F.coalesce("adjusted", "original")).alias("delta"))
    return lost.filter("delta > 0").select("key", F.round(F.greatest(F.col("overall") - F.col("delta") / max(n_criteria, 1), F.lit(0.0)), 2).alias("adjusted"))


def cited(evidence: DataFrame, request: str) -> DataFrame:
    """number: citations of each request run over its shortlist by rank, then criterion; entries without a snippet have none,
    and aren't returned. Rows of one request are sorted in one task, which holds one row at a time."""
    w = Window.partitionBy(request).orderBy("rank", "criterion_pos")
    return evidence.filter(F.coalesce(F.col("snippet"), F.lit("")) != "").withColumn("number", F.row_number().over(w))
