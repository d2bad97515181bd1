"""Amounts on columns: two cleaners, cost, progressive tax."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.entities import let

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# What the rules' cleaner takes out, in this order.
RULE_MARKS = [",", "₹", "Rs.", "Rs", "$", "€", "£", "INR", "USD", "EUR"]


def number(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def rule_amount(text: Column) -> Column:
    def cleaned(t: Column) -> Column:
        return number(F.trim(reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), RULE_MARKS, t)))

    return let(text, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")).otherwise(cleaned(t)))  # numbers have no marks


def score_amount(text: Column) -> Column:
    return number(F.regexp_replace(text, r"[₹$€£,\s]", ""))


def cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    """In dollars from prices (decimals) per million tokens; unknown prices or usage give null.

    Tokens times prices are exact millionths of a dollar, rounded once, half away from zero."""
    exact = prompt.cast("decimal(18,0)") * input_price.cast("decimal(12,4)") + completion.cast("decimal(18,0)") * output_price.cast("decimal(12,4)")
    return F.round(exact, 0).cast("double") / F.lit(1e6)


def slab_tax(income: Column, slabs: list[tuple[float, float]]) -> Column:
    """slabs: (upto, rate), the last one unbounded."""
    lower, parts = 0.0, []
    for upto, rate in slabs:
        top = income if upto == float("inf") else F.least(income, F.lit(float(upto)))
        parts.append(F.greatest(top - F.lit(lower), F.lit(0.0)) * F.lit(rate))
        lower = float(upto)
    return reduce(lambda a, b: a + b, parts)
