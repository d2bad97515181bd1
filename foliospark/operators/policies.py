"""Row policies: who may see which rows, as existence joins rather than pairs of users and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, **wanted) -> DataFrame:  # noqa: ANN003
    """Rows that equal every value given; a filter of None asks for nothing."""
    return reduce(lambda d, x: d.filter(F.col(x[0]) == F.lit(x[1])), ((k, v) for k, v in wanted.items() if v is not None), df)


def subscribed(hooks: DataFrame, event: str) -> DataFrame:
    """Active hooks whose list of events has this one."""
    return hooks.filter(F.col("active") & F.array_contains("events", event))


def permitted(rows: DataFrame, own: Column, *memberships: tuple[str, DataFrame, str]) -> DataFrame:
    """Rows that are the viewer's own, or whose column stands in one of the viewer's memberships: (column, table, key).

    A table of memberships holds those of one viewer; each row is flagged at most once, whatever it repeats."""
    flags, marked = [F.coalesce(own, F.lit(False))], rows
    for i, (column, table, key) in enumerate(memberships):
        mine = table.select(F.col(key).alias(f"__key{i}"), F.lit(True).alias(f"__mine{i}")).distinct()
        marked = marked.join(mine, F.col(column) == F.col(f"__key{i}"), "left")
        flags.append(F.coalesce(f"__mine{i}", F.lit(False)))
    return marked.filter(reduce(lambda a, b: a | b, flags)).select(*rows.columns)


def roles(viewer_org: Column, viewer_team: Column, org: Column, team: Column, admin: Column, lead: Column) -> dict[str, Column]:
    """Isolation by organisation, access by team, and what a role adds."""
    same_org = F.coalesce(viewer_org == org, F.lit(False))
    same_team = F.coalesce(viewer_team == team, F.lit(False))
    return {"same_org": same_org, "same_team": same_team, "reads_team": same_team & (lead | admin), "manages_org": same_org & admin}


def template_counts(templates: DataFrame, viewers: DataFrame) -> DataFrame:
    """viewer and how many templates each sees: global ones, own ones, and those of team and organisation.

    Templates are counted by scope and owner first, so that no pair of a viewer and a template is made."""
    count = lambda scope, by: templates.filter(F.col("scope") == scope).groupBy(F.col(by).alias(f"_{scope}")).agg(F.count("*").alias(f"n_{scope}"))
    every = templates.filter("scope = 'global'").agg(F.count("*").alias("everyone"))
    seen = viewers
    for scope, by, mine in (("own", "owner", "viewer"), ("team", "team", "team"), ("org", "org", "org")):
        seen = seen.join(count(scope, by), F.col(mine) == F.col(f"_{scope}"), "left")
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in ("n_own", "n_team", "n_org")))
    return seen.crossJoin(F.broadcast(every)).select("viewer", (total + F.col("everyone")).alias("n_visible"))
