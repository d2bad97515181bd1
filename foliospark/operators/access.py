"""Who sees what: documents, chunks, audit rows, quotas, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(documents: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, doc_id) pairs. documents(doc_id, owner, team_id, org_id, visibility), members(user_id, team_id, org_id,
    role, reads_teams, active): the owner; the team's members; active admins of the organisation that may read teams'
    documents; the organisation's active members."""
    own = documents.select(F.col("owner").alias("user_id"), "doc_id")
    team = documents.filter("visibility = 'team'").join(members.select("user_id", "team_id"), "team_id").select("user_id", "doc_id")
    admins = members.filter("role = 'org_admin' and reads_teams and active").select("user_id", "org_id")
    admin = documents.filter("visibility = 'team'").join(admins, "org_id").select("user_id", "doc_id")
    org = documents.filter("visibility = 'org'").join(members.filter("active").select("user_id", "org_id"), "org_id").select("user_id", "doc_id")
    return own.union(team).union(admin).union(org).distinct()


def visible_totals(documents: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, n, checksum (sum of doc_id) of the pairs of `visible`, without the pairs: documents that the same teams and
    organisations may see are added up first, and so are users of the same memberships. Only an owner's own documents are
    looked at one by one, as those count that are not seen otherwise."""
    scope = F.when(F.col("visibility").isin("team", "org"), F.struct("visibility", "team_id", "org_id"))
    shared = documents.groupBy("doc_id").agg(F.array_sort(F.collect_set(scope)).alias("scopes"), F.collect_set(F.struct("owner")).alias("owners"))
    kinds = shared.filter("size(scopes) > 0").groupBy("scopes").agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))

    admin = F.col("role").eqNullSafe("org_admin") & F.coalesce(F.col("reads_teams") & F.col("active"), F.lit(False))
    own = F.struct("team_id", "org_id", admin.alias("admin"), F.coalesce("active", F.lit(False)).alias("active"))
    users = members.groupBy("user_id").agg(F.array_sort(F.collect_set(own)).alias("places"))

    # a kind meets a place by its team, its organisation if team documents are read there, or its organisation
    place = users.select("places").distinct().select("places", F.explode("places").alias("p"))
    of_place = place.select("places", F.explode(F.array(
        F.struct(F.lit("team").alias("by"), F.col("p.team_id").alias("id")),
        F.struct(F.when(F.col("p.admin"), "admin").alias("by"), F.col("p.org_id").alias("id")),
        F.struct(F.when(F.col("p.active"), "org").alias("by"), F.col("p.org_id").alias("id")))).alias("k")).select("places", "k.*")
    of_kind = kinds.select("*", F.explode("scopes").alias("s")).select("scopes", "n", "checksum", F.explode(F.when(F.col("s.visibility") == "org", F.array(F.struct(F.lit("org").alias("by"), F.col("s.org_id").alias("id")))).otherwise(F.array(
        F.struct(F.lit("team").alias("by"), F.col("s.team_id").alias("id")), F.struct(F.lit("admin").alias("by"), F.col("s.org_id").alias("id"))))).alias("k")).select("scopes", "n", "checksum", "k.*")
    met = of_place.join(of_kind, ["by", "id"]).select("places", "scopes", "n", "checksum").distinct()
    seen = users.join(met.groupBy("places").agg(F.sum("n").alias("n"), F.sum("checksum").alias("checksum")), "places").select("user_id", "n", "checksum")

    held = shared.select(F.explode("owners").alias("o"), "doc_id", "scopes").select("o.owner", "doc_id", "scopes").join(users, F.col("owner").eqNullSafe(F.col("user_id")), "left")
    opens = lambda s, p: F.when(s["visibility"] == "org", p["active"] & (s["org_id"] == p["org_id"])).otherwise((s["team_id"] == p["team_id"]) | (p["admin"] & (s["org_id"] == p["org_id"])))
    otherwise = F.exists("scopes", lambda s: F.exists("places", lambda p: F.coalesce(opens(s, p), F.lit(False))))
    alone = held.filter(~F.coalesce(otherwise, F.lit(False))).groupBy(F.col("owner").alias("user_id")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))
    return seen.unionByName(alone).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("checksum").alias("checksum"))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: the rows whose key isn't deleted."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def first_membership(members: DataFrame) -> DataFrame:
    """user_id, org_id, team_id: the smallest active organisation, and its smallest team."""
    return members.filter("active").groupBy("user_id").agg(F.min(F.struct("org_id", "team_id")).alias("m")).select("user_id", "m.org_id", "m.team_id")
