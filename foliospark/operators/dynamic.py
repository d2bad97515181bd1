"""Records of any declared shape: types compiled from templates, values without their places, scores, verification and rules
that only the shape decides. All are expressions over one struct column; no rows move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.dates import once
from foliospark.operators import records, reshape
from foliospark.operators import validate as v

# Fields of each template, in order.
TEMPLATES = {
    "invoice": ["vendor_name", "vendor_address", "client_name", "invoice_number", "invoice_date", "due_date", "subtotal", "tax_amount", "total_amount", "payment_terms", "line_items"],
    "cv_resume": ["full_name", "email", "phone", "location", "linkedin", "current_title", "current_company", "total_experience_years", "skills", "education", "languages", "summary"],
    "contract": ["party_1", "party_2", "agreement_type", "effective_date", "expiry_date", "governing_law", "key_obligations", "payment_terms", "confidentiality_clause", "termination_clause"],
    "bank_statement": ["account_holder", "account_number", "bank_name", "statement_period", "opening_balance", "closing_balance", "total_credits", "total_debits", "currency"],
    "gst_return": ["gstin", "legal_name", "trade_name", "filing_period", "return_type", "taxable_turnover", "total_tax_liability", "tax_paid", "late_fee"],
    "offer_letter": ["candidate_name", "job_title", "department", "reporting_to", "joining_date", "base_salary", "total_ctc", "probation_period", "work_location", "offer_expiry"],
    "loan_application": ["applicant_name", "applicant_dob", "loan_type", "loan_amount_requested", "loan_tenure", "annual_income", "employer_name", "employment_type", "existing_loans", "collateral"],
    "general": ["title", "author", "date", "summary", "key_points", "entities", "amounts", "dates"],
    "custom": ["field_name", "another_field"],
}
# Fields of templates that hold lists.
LISTS = ["line_items", "skills", "languages", "key_obligations", "key_points", "entities", "amounts", "dates"]
#: What `verified` adds to an item; no field of the record.
CHECK = "verification"


def template(name: str) -> list[dict]:
    """A template as a declared shape: every field a text, or a list of texts."""
    return [{"name": f, "type": "list" if f in LISTS else "string"} for f in TEMPLATES[name]]


def parsed(text: Column, spec: list[dict]) -> Column:
    """A JSON text as a record of the declared shape: fields that it lacks are null, others go; null if it is no object."""
    return F.from_json(text, reshape.schema(spec).json())


def outline(kind: T.StructType, depth: int = 0) -> list[str]:
    """Lines that show a shape, nested fields two blanks further in."""
    lines = []
    for f in kind.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        name = "list" if isinstance(f.dataType, T.ArrayType) else "object" if isinstance(inner, T.StructType) else f.dataType.simpleString()
        lines.append(f"{'  ' * depth}- {f.name} ({name})")
        lines += outline(inner, depth + 1) if isinstance(inner, T.StructType) else []
    return lines


def _placed(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and set(kind.names) == {"value", "bbox"}


def unwrapped(value: Column, kind: T.DataType) -> Column:
    """{value, bbox} records as their values, at any depth of records and lists."""
    if _placed(kind):
        return unwrapped(value["value"], kind["value"].dataType)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(unwrapped(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unwrapped(x, kind.elementType))
    return value


def empty(value: Column, kind: T.DataType) -> Column:
    """Null, an empty text or an empty list; numbers and records are empty only if null."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def _own(kind: T.StructType) -> list[T.StructField]:
    return [f for f in kind.fields if f.name != CHECK]


def filled_share(record: Column, kind: T.StructType) -> Column:
    """Share of a record's fields that aren't empty; 0 for a null record and for one without fields."""
    own = _own(kind)
    if not own:
        return F.lit(0.0)
    n = reduce(lambda a, b: a + b, (F.when(empty(record[f.name], f.dataType), 0).otherwise(1) for f in own))
    return F.when(record.isNull(), 0.0).otherwise(n / len(own))


def confidence(value: Column, kind: T.DataType, name: str) -> Column:
    """0 to 1 by the type: a record by its filled share, a list of records by the mean of its items' shares (two digits, ties to
    the even one), other lists 0.9 unless empty, numbers and truth values 0.95, texts by what the name asks of them. A list
    whose first item is null counts as a plain list."""
    if isinstance(kind, T.StructType):
        return F.bround(filled_share(value, kind), 2)
    if isinstance(kind, T.ArrayType):
        plain = F.when(F.size(value) > 0, 0.9).otherwise(0.0)
        if not isinstance(kind.elementType, T.StructType):
            return F.when(value.isNull(), 0.0).otherwise(plain)
        total = F.aggregate(value, F.lit(0.0), lambda a, i: a + filled_share(i, kind.elementType))
        return F.when(value.isNull() | (F.size(value) == 0), 0.0).when(F.get(value, 0).isNull(), plain).otherwise(F.bround(total / F.size(value), 2))
    if isinstance(kind, T.StringType):
        return v.confidence(value, v.named_type(name))
    return F.when(value.isNull(), 0.0).otherwise(0.95)


def _kind(df: DataFrame, record: str) -> T.StructType:
    kind = df.schema[record].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{record} is no record but {kind.simpleString()}")
    return kind


def scores(df: DataFrame, record: str) -> Column:
    """array of field, field_type, confidence, status, colour over the fields of a record column, in the shape's order. A null
    record scores 0 in every field."""
    kind = _kind(df, record)

    def scored(f: T.StructField) -> Column:
        def labelled(score: Column) -> Column:
            label = v.status(score)
            return F.struct(F.lit(f.name).alias("field"), F.lit(v.named_type(f.name)).alias("field_type"), score.alias("confidence"), label.alias("status"), v.colour(label).alias("colour"))

        return once(confidence(F.col(record)[f.name], f.dataType, f.name), labelled)

    return F.array(*map(scored, _own(kind)))


def found_count(record: Column, kind: T.StructType) -> Column:
    """How many fields of a record are found: as `validate.overall` counts them in `scores`, which aren't made for it."""
    return reduce(lambda a, b: a + b, (F.when(v.found(confidence(record[f.name], f.dataType, f.name)), 1).otherwise(0) for f in _own(kind))).cast("long")


def pairs(kind: T.StructType) -> dict[str, dict]:
    """List fields whose items have a start and an end by their names: field to names of start, end and duration."""
    names = {T.StringType: "string", T.DateType: "date", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number"}
    found = {}
    for f in kind.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = [{"name": i.name, "type": names.get(type(i.dataType), "other")} for i in _own(f.dataType.elementType)]
            found[f.name] = records.date_pair(inner)
    return {name: pair for name, pair in found.items() if pair}


def verified(df: DataFrame, record: str, as_of: Column) -> DataFrame:
    """df whose list items with a start and an end carry `verification` (computed, stated, match, backfilled); other fields stay
    as they are. Starts, ends and durations that are no texts become texts. Null records and null lists stay null, null items
    too."""
    kind = _kind(df, record)

    rec = out = F.col(record)
    for name, pair in pairs(kind).items():
        inner = kind[name].dataType.elementType
        other = [n for n in pair.values() if n and not isinstance(inner[n].dataType, T.StringType)]
        texts = F.transform(rec[name], lambda i, other=other: reduce(lambda a, n: a.withField(n, i[n].cast("string")), other, i)) if other else rec[name]
        out = out.withField(name, records.verified(texts, pair, as_of))
    return df.withColumn(record, out)


def findings(df: DataFrame, record: str) -> Column:
    """array of field, rule_code, status, detail: items of lists that lack sub-fields (GENERIC_001; none of a list whose first
    item is null), empty fields (002), verified durations that differ (003). All warn and block nothing. A null record has
    no fields, and so no findings."""
    rec, kind = F.col(record), _kind(df, record)
    shape = "array<struct<field:string,rule_code:string,status:string,detail:string>>"

    def one(field: Column, code: str, detail: Column) -> Column:
        return F.struct(field.alias("field"), F.lit(code).alias("rule_code"), F.lit("WARNING").alias("status"), detail.alias("detail"))

    def listed(f: T.StructField) -> list[Column]:
        inner = f.dataType.elementType
        at = lambda i: F.concat(F.lit(f"{f.name}["), i.cast("string"), F.lit("]"))

        def missing(x: Column, i: Column) -> Column:
            gone = [(s.name, empty(x[s.name], s.dataType)) for s in _own(inner)]
            names = F.concat_ws(", ", *(F.when(lacks, F.lit(name)) for name, lacks in gone))
            return F.when(x.isNotNull() & v.any_of([lacks for _, lacks in gone]), one(at(i), "GENERIC_001", F.concat(F.lit("missing: "), names)))

        def differs(x: Column, i: Column) -> Column:
            c = x[CHECK]
            return F.when(c["match"] == F.lit(False), one(at(i), "GENERIC_003", F.concat(F.lit("stated "), c["stated"], F.lit(", computed "), c["computed"])))

        first = [F.when(F.get(rec[f.name], 0).isNotNull(), F.transform(rec[f.name], missing))] if _own(inner) else []
        return first + ([F.transform(rec[f.name], differs)] if CHECK in inner.names else [])

    nested = [e for f in kind.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) for e in listed(f)]
    flat = F.array(*(F.when(empty(rec[f.name], f.dataType), one(F.lit(f.name), "GENERIC_002", F.lit("empty or null"))) for f in _own(kind)))
    none = F.array().cast(shape)
    found = F.filter(F.concat(*(F.coalesce(x.cast(shape), none) for x in [*nested, flat])), lambda x: x.isNotNull())
    return F.when(rec.isNull(), none).otherwise(found)
