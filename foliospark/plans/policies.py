"""Row policies over the driver's tables: customers as users, nations as teams, regions as organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import policies
from foliospark.plans.registry import query
from foliospark.plans.usage import CALLS, calls
from foliospark.session import load

USERS = "u AS (SELECT c_custkey AS user_id, c_nationkey AS team, n_regionkey AS org, c_custkey % 10 = 0 AS admin, c_custkey % 4 = 0 AS lead FROM customer JOIN nation ON n_nationkey = c_nationkey)"
#: The user whose view is asked for; an administrator of an organisation.
VIEWER = 10


def users(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return both.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("team"), F.col("n_regionkey").alias("org"), (F.col("c_custkey") % 10 == 0).alias("admin"), (F.col("c_custkey") % 4 == 0).alias("lead"))


@query("SELECT c_custkey AS hook_id FROM customer WHERE c_acctbal > 0 AND list_contains(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'click' END, CASE WHEN c_custkey % 3 = 0 THEN 'purchase' END, CASE WHEN c_custkey % 5 = 0 THEN 'view' END], lambda x: x IS NOT NULL), 'purchase')")
def subscribed_hooks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    events = F.array_compact(F.array(F.when(key % 2 == 0, "click"), F.when(key % 3 == 0, "purchase"), F.when(key % 5 == 0, "view")))
    hooks = load(spark, d, "customer").select(key.alias("hook_id"), (F.col("c_acctbal") > 0).alias("active"), events.alias("events"))
    return policies.subscribed(hooks, "purchase").select("hook_id")


@query(f"WITH {CALLS} SELECT event_id, user_id, tokens FROM c WHERE call_type = 'view' AND NOT cache_hit")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return policies.matching(calls(spark, d), call_type="view", user_id=None, cache_hit=False, tokens=None).select("event_id", "user_id", "tokens")


@query(f"WITH {USERS} SELECT event_id, v.org = o.org AS same_org, v.team = o.team AS same_team, v.team = o.team AND (v.lead OR v.admin) AS reads_team, v.org = o.org AND v.admin AS manages_org FROM events e JOIN u o ON o.user_id = e.user_id JOIN u v ON v.user_id = e.event_id % 100 + 1")
def role_predicates(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    owner = u.select("user_id", F.col("org").alias("o_org"), F.col("team").alias("o_team"))
    viewer = u.select(F.col("user_id").alias("viewer"), "org", "team", "admin", "lead")
    pairs = load(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 100 + 1).alias("viewer")).join(owner, "user_id").join(viewer, "viewer")
    found = policies.roles(F.col("org"), F.col("team"), F.col("o_org"), F.col("o_team"), F.col("admin"), F.col("lead"))
    return pairs.select("event_id", *(c.alias(n) for n, c in found.items()))


@query(f"""WITH {USERS}, t AS (SELECT p_partkey, ['global', 'own', 'team', 'org'][p_size % 4 + 1] AS scope, user_id AS owner, team, org FROM part JOIN u ON user_id = p_partkey % 150 + 1)
SELECT v.user_id AS viewer, count(t.p_partkey) AS n_visible FROM u v LEFT JOIN t ON t.scope = 'global' OR t.scope = 'own' AND t.owner = v.user_id OR t.scope = 'team' AND t.team = v.team OR t.scope = 'org' AND t.org = v.org WHERE v.user_id % 10 = 0 GROUP BY v.user_id""")
def visible_templates(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    scope = F.element_at(F.array(*map(F.lit, ("global", "own", "team", "org"))), F.col("p_size") % 4 + 1)
    made = load(spark, d, "part").select(scope.alias("scope"), (F.col("p_partkey") % 150 + 1).alias("owner")).join(u.select(F.col("user_id").alias("owner"), "team", "org"), "owner")
    return policies.template_counts(made, u.filter("user_id % 10 = 0").select(F.col("user_id").alias("viewer"), "team", "org"))


@query(f"WITH {USERS}, mine AS (SELECT o_orderkey FROM orders JOIN u ON user_id = o_custkey WHERE o_custkey = {VIEWER} OR team IN (SELECT team FROM u WHERE user_id = {VIEWER})) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM mine)")
def visible_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts follow what they belong to: lines of the orders that the viewer sees."""
    u = users(spark, d)
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")).join(u.select("user_id", "team"), "user_id")
    seen = policies.permitted(orders, F.col("user_id") == VIEWER, ("team", u.filter(F.col("user_id") == VIEWER), "team"))
    return load(spark, d, "lineitem").join(seen, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query(f"WITH {USERS} SELECT event_id FROM events JOIN u USING (user_id) WHERE user_id = {VIEWER} OR org IN (SELECT org FROM u WHERE user_id = {VIEWER} AND admin)")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    rows = load(spark, d, "events").select("event_id", "user_id").join(u.select("user_id", "org"), "user_id")
    return policies.permitted(rows, F.col("user_id") == VIEWER, ("org", u.filter((F.col("user_id") == VIEWER) & F.col("admin")), "org")).select("event_id")


@query(f"WITH {USERS}, q AS (SELECT c_custkey AS quota_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS team, CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 5 END AS org FROM customer) SELECT quota_id FROM q WHERE user_id = {VIEWER} OR team IN (SELECT team FROM u WHERE user_id = {VIEWER}) OR org IN (SELECT org FROM u WHERE user_id = {VIEWER})")
def visible_quotas(spark: SparkSession, d: str) -> DataFrame:
    key, me = F.col("c_custkey"), users(spark, d).filter(F.col("user_id") == VIEWER)
    quotas = load(spark, d, "customer").select(key.alias("quota_id"), F.when(key % 3 == 0, key).alias("user_id"), F.when(key % 3 == 1, F.col("c_nationkey")).alias("team"), F.when(key % 3 == 2, key % 5).alias("org"))
    return policies.permitted(quotas, F.col("user_id") == VIEWER, ("team", me, "team"), ("org", me, "org")).select("quota_id")


@query(f"WITH {USERS} SELECT s_suppkey AS key_id FROM supplier JOIN u ON user_id = s_suppkey % 150 + 1 WHERE user_id = {VIEWER} OR s_suppkey % 2 = 0 AND org IN (SELECT org FROM u WHERE user_id = {VIEWER} AND admin)")
def visible_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one's own, and those of the organisation's scope for its administrators."""
    u = users(spark, d)
    keys = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key_id"), (F.col("s_suppkey") % 150 + 1).alias("user_id")).join(u.select("user_id", "org"), "user_id")
    scoped = keys.withColumn("scope_org", F.when(F.col("key_id") % 2 == 0, F.col("org")))
    return policies.permitted(scoped, F.col("user_id") == VIEWER, ("scope_org", u.filter((F.col("user_id") == VIEWER) & F.col("admin")), "org")).select("key_id")
