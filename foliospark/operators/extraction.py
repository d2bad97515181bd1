"""What extracted records say: values without their places, completeness, income for a tax return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unwrapped(field: Column) -> Column:
    """The value of a {value, bbox} field."""
    return field["value"]


def has_value(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def coverage(fields: dict[str, Column]) -> list[Column]:
    """How many {value, bbox} fields have a value, and how many a place."""
    add = lambda flags: sum((f.cast("int") for f in flags), F.lit(0)).cast("long")
    return [add(f["value"].isNotNull() for f in fields.values()).alias("fields_with_value"), add(f["bbox"].isNotNull() for f in fields.values()).alias("fields_with_bbox")]


def batch_result(status: Column) -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(status == "done").alias("succeeded"), F.count_if(status == "failed").alias("failed")]


def is_empty(df: DataFrame, name: str) -> Column:
    """Null, an empty text, or an empty list; a number, a map and a record are never empty otherwise."""
    kind, value = dict(df.dtypes)[name], F.col(name)
    if kind.startswith("array"):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if kind == "string" else value.isNull()


def empty_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, rule_code, status of every field that came back empty: a warning that blocks nothing."""
    names = F.filter(F.array(*(F.when(is_empty(df, f), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    return df.select(key, F.explode(names).alias("field")).select(key, "field", F.lit("GENERIC_002").alias("rule_code"), F.lit("WARNING").alias("status"))


def duration_mismatches(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, field and message of every list item whose stated duration is verified and differs; unverified ones pass."""
    each = df.select(key, F.posexplode(items).alias("i", "v")).filter(F.col("v.match") == F.lit(False))
    field = F.concat(F.lit(f"{items}["), F.col("i").cast("string"), F.lit("]"))
    return each.select(key, field.alias("field"), F.lit("GENERIC_003").alias("rule_code"), F.concat(F.lit("stated "), F.coalesce("v.stated", F.lit("nothing")), F.lit(", computed "), F.col("v.computed")).alias("actual"))


def missing_keys(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, i and the keys that some sibling has and this item of a list of maps lacks."""
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(items, F.map_keys))))
    return df.select(key, names.alias("n"), F.posexplode(items).alias("i", "m")).select(key, "i", F.array_except("n", F.map_keys("m")).alias("missing")).filter(F.size("missing") > 0)


def salary_income(entries: Column) -> list[Column]:
    """Totals over an array of salary certificates; without a gross amount its three parts count; a null array has none."""

    def total(of) -> Column:  # noqa: ANN001
        return F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.coalesce(of(e).cast("double"), F.lit(0.0)))

    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return [
        total(lambda e: F.coalesce(e["gross"], zero(e["salary"]) + zero(e["perquisites"]) + zero(e["profits"]))).alias("gross_total"), total(lambda e: e["hra"]).alias("hra_total"), total(lambda e: e["professional_tax"]).alias("professional_tax_total"),
        total(lambda e: F.aggregate(F.coalesce(e["deductions"], F.array().cast("array<double>")), F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))).alias("deductions_total"),
    ]


def return_type(sales: Column, certificates: Column, confirmed: Column) -> list[Column]:
    """Which form, and whether the run goes on or asks for a salary certificate first."""
    return [F.when(sales > 0, "ITR2").otherwise("ITR1").alias("itr_type"), F.when((certificates > 0) | confirmed, "calculate").otherwise("ask").alias("next_stage")]


def numeric_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_numbers, total of each column: thousands separators go, what is no number doesn't count."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double").alias("x")) for c in columns))).alias("c"))
    return cells.groupBy("c.column").agg(F.count("c.x").alias("n_numbers"), F.round(F.sum("c.x"), 4).alias("total"))
