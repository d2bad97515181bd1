"""Score grids, shortlists and progressive tax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.money import slab_tax

TOP_TIMES, TOP_SHARE, MENTIONS = 1.5, 0.35, 3
# The tax year's rules. Slabs are (upto, rate).
NEW_SLABS = [(400_000, 0.00), (800_000, 0.05), (1_200_000, 0.10), (1_600_000, 0.15), (2_000_000, 0.20), (2_400_000, 0.25), (float("inf"), 0.30)]
OLD_SLABS = [(250_000, 0.00), (500_000, 0.05), (1_000_000, 0.20), (float("inf"), 0.30)]
SURCHARGE = [(5_000_000, 0.00), (10_000_000, 0.10), (20_000_000, 0.15), (float("inf"), 0.25)]
REGIMES = {
    "new": {"slabs": NEW_SLABS, "standard": 75_000.0, "rebate_to": 1_200_000.0, "rebate": 60_000.0, "exemptions": False},
    "old": {"slabs": OLD_SLABS, "standard": 50_000.0, "rebate_to": 500_000.0, "rebate": 12_500.0, "exemptions": True},
}
STCG, LTCG, LTCG_FREE, HOLDING_DAYS, CESS = 0.20, 0.125, 125_000.0, 365, 0.04


def grid(candidates: DataFrame, criteria: DataFrame, scores: DataFrame) -> DataFrame:
    """Every candidate with every criterion, 0 where no score is; criteria are a short list of the request."""
    return candidates.crossJoin(F.broadcast(criteria)).join(scores, ["candidate", "criterion"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def to_verify(ranked: DataFrame, requested: int | None) -> DataFrame:
    """The best by rank: half as many again as requested, or a share of all."""
    total = ranked.agg(F.count("*").alias("_total"))
    size = F.ceil(F.lit(requested * TOP_TIMES)) if requested else F.ceil(F.col("_total") * TOP_SHARE)
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("rank") <= F.greatest(F.lit(1), F.least(size, F.col("_total")))).drop("_total")


def swapped(order: Column, swaps: Column) -> Column:
    """An array of ids after swaps (a, b) in turn, each applied only if both stand next to each other just then."""

    def step(o: Column, s: Column) -> Column:
        i, j = F.array_position(o, s["a"]), F.array_position(o, s["b"])
        change = F.transform(o, lambda x: F.when(x == s["a"], s["b"]).when(x == s["b"], s["a"]).otherwise(x))
        return F.when((i > 0) & (j > 0) & (F.abs(i - j) == 1), change).otherwise(o)

    return F.aggregate(swaps, order, step)


def gains(trades: DataFrame, key: str) -> DataFrame:
    """key, stcg, ltcg: gains by holding days; trades without a date count as short."""
    gain = F.coalesce("sell_value", F.lit(0.0)) - F.coalesce("buy_value", F.lit(0.0))
    short = F.coalesce(F.datediff("sell_date", "buy_date") <= HOLDING_DAYS, F.lit(True))
    return trades.groupBy(key).agg(F.round(F.sum(F.when(short, gain).otherwise(0.0)), 2).alias("stcg"), F.round(F.sum(F.when(short, 0.0).otherwise(gain)), 2).alias("ltcg"))


def gains_tax(stcg: Column, ltcg: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(stcg, zero) * STCG + F.greatest(ltcg - LTCG_FREE, zero) * LTCG


def tax(regime: str, gross: Column, exempt: Column, professional: Column, deductions: Column, other: Column, stcg: Column, ltcg: Column) -> Column:
    """Tax payable in a regime, to two places."""
    r, zero = REGIMES[regime], F.lit(0.0)
    salary = gross - r["standard"] - ((exempt + professional) if r["exemptions"] else 0.0)
    income = F.greatest(F.greatest(salary, zero) + other - (deductions if r["exemptions"] else 0.0), zero)
    slab = slab_tax(income, r["slabs"])
    slab = F.when(income <= r["rebate_to"], F.greatest(slab - r["rebate"], zero)).otherwise(slab)
    base = slab + gains_tax(stcg, ltcg)
    whole = income + F.greatest(stcg, zero) + F.greatest(ltcg, zero)
    rate = F.lit(SURCHARGE[-1][1])
    for upto, part in reversed(SURCHARGE[:-1]):
        rate = F.when(whole <= float(upto), F.lit(part)).otherwise(rate)
    return F.round((base + base * rate) * (1 + CESS), 2)


def shortlist(ranked: DataFrame, n: int) -> DataFrame:
    """The n best, and some after them as mentions."""
    return ranked.filter(F.col("rank") <= n + MENTIONS).withColumn("kind", F.when(F.col("rank") <= n, "shortlist").otherwise("mention"))


def placed(df: DataFrame, score: str, key: str) -> DataFrame:
    """rank from 1 by score, ties to the smaller key."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
