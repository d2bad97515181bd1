"""Chunks, nested records, rulesets, keys, cells and adapters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import adapters, chunk, records
from foliospark.plans.registry import query
from foliospark.plans.retrieval import chunks
from foliospark.session import load
from foliospark.sources import tables


@query()
def flat_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunked(chunks(spark, d)).select("doc_id", "page_num", "chunk_id", "n", F.length("content").alias("size"))


@query()
def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunked(chunks(spark, d), "hierarchy").groupBy("doc_id", "level").agg(F.count("*").alias("chunks"), F.count("parent_id").alias("with_parent"))


@query(f"""WITH m AS (SELECT *, greatest(0, (year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN day(e) < day(s) THEN 1 ELSE 0 END) AS k FROM (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS s, l_shipdate::DATE AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
c AS (SELECT *, CASE WHEN k // 12 = 0 THEN k || 'm' WHEN k % 12 = 0 THEN (k // 12) || 'y' ELSE (k // 12) || 'y ' || (k % 12) || 'm' END AS computed, CASE l_linenumber % 3 WHEN 1 THEN '1M ' WHEN 2 THEN '9y' END AS stated FROM m)
SELECT l_orderkey, count(*) FILTER (replace(lower(trim(stated)), ' ', '') = computed) AS matches, count(*) FILTER (stated IS NULL) AS backfilled FROM c GROUP BY l_orderkey""")
def item_verification(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    stated = F.when(F.col("l_linenumber") % 3 == 1, "1M ").when(F.col("l_linenumber") % 3 == 2, "9y").otherwise("")
    item = F.struct(F.col("start").alias("start_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("end_date"), stated.alias("total_time"))
    nested = load(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(item).alias("jobs"))
    pair = records.date_pair([{"name": n, "type": "string"} for n in ("start_date", "end_date", "total_time")])
    done = nested.select("l_orderkey", records.verified(F.col("jobs"), pair, F.lit("2024-01-01").cast("date")).alias("jobs"))
    n = lambda f: F.size(F.filter("jobs", lambda j: F.coalesce(j["verification"][f], F.lit(False)))).cast("long")
    return done.select("l_orderkey", n("match").alias("matches"), n("backfilled").alias("backfilled"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 9 END AS passed, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS failed, c_custkey % 2 <> 0 AS is_valid FROM customer")
def contract_ruleset(spark: SparkSession, d: str) -> DataFrame:
    """A contract's rules: every other customer lacks the second party."""
    rows = load(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("party_1"), F.when(F.col("c_custkey") % 2 == 1, F.lit("Other side")).alias("party_2"), F.lit("2020-01-01").alias("effective_date"), F.lit("nda").alias("agreement_type"),
        F.lit("2021-01-01").alias("expiry_date"), F.array(F.lit("pay")).alias("key_obligations"),
    )
    from foliospark.operators.validate import summed

    done = summed(records.judged(rows, "nda", "c_custkey", F.lit("2024-01-01").cast("date")), "c_custkey", "results")
    # a party that isn't there has no length either
    return done.select("c_custkey", F.col("passed").cast("int").alias("passed"), F.col("failed").cast("int").alias("failed"), "is_valid")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 100 >= 50 THEN 'rate limit' ELSE 'valid' END WHEN 1 THEN CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'valid_rotating' ELSE 'expired' END ELSE 'invalid' END AS state FROM events")
def api_keys(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 4 == 0, "active").when(e % 4 == 1, "rotating").otherwise("revoked")
    ts = F.col("ts")
    return load(spark, d, "events").select("event_id", records.key_state(status, e % 100, F.to_date(ts), F.lit(50), F.lit("2024-01-15").cast("timestamp_ntz"), ts).alias("state"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'groq/llama,openai/gpt' WHEN 1 THEN 'openai/a:b' WHEN 2 THEN '' ELSE 'groq/x' END AS chain FROM part")
def model_chain(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " Groq:llama , openai: gpt,bad").when(k == 1, "other:x,openai:a:b").when(k == 2, "none").otherwise("groq:x")
    parsed = records.chain(raw, ["groq", "openai"])
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(parsed, lambda p: F.concat(p["provider"], F.lit("/"), p["model"])), ",").alias("chain"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'education' WHEN 1 THEN 'experience' WHEN 2 THEN 'skill:data' WHEN 3 THEN 'skill:web' END AS criterion FROM part")
def claim_criteria(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    field = F.when(k == 0, "Higher Education").when(k == 1, "work experience").when(k == 2, "Spark at scale").when(k == 3, "WEB things").otherwise("hobbies")
    return load(spark, d, "part").select("p_partkey", records.criterion(field, None, [("data", ["spark", "sql"]), ("web", ["react"])]).alias("criterion"))


@query("WITH s AS (SELECT l_orderkey AS key, max(o_totalprice) AS overall, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - l_quantity / 2 ELSE 0 END) AS delta FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey) SELECT key, round(greatest(overall - delta / 7, 0), 2) AS adjusted FROM s WHERE delta > 0")
def adjusted_scores(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("overall"))
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("original"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 2).alias("adjusted"))
    return records.without_claims(rows.join(o, "key"), 7)


@query("SELECT s_suppkey, unnest([0, 1, 2]) AS col, unnest(['s_name', 's_nationkey', 's_acctbal']) AS header, unnest([s_name, s_nationkey::VARCHAR, NULL]) AS value FROM supplier")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.lit(None).cast("string").alias("s_acctbal"))
    return tables.cells(rows, "s_suppkey")


@query("WITH n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier) SELECT s_nationkey, n // 50 + 1 AS page_num, 'Columns: s_name' || chr(10) || chr(10) || string_agg(s_name, chr(10) ORDER BY n) AS text FROM n JOIN supplier USING (s_suppkey, s_nationkey) GROUP BY ALL")
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.paged_rows(load(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_suppkey", "s_nationkey")


@query("SELECT conv_id * 1000 + turn AS id, sha256(concat_ws('|', role, 'm', 's', text)) AS key, substring(sha256(text), 1, 12) AS answer, turn % 2 = 0 AND role = 'user' AS hit FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.role = conversations.role AND c.text = conversations.text AND (c.conv_id, c.turn) <> (conversations.conv_id, conversations.turn))")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur once; the cache knows every other turn of users."""
    c = load(spark, d, "conversations")
    once = c.groupBy("role", "text").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("turn").alias("turn")).filter("n = 1")
    calls = once.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("user"), F.lit("m").alias("model"), F.lit("s").alias("system"), "text", "turn")
    known = calls.filter("turn % 2 = 0 and user = 'user'").select(adapters.prompt_hash(F.col("user"), F.col("model"), F.col("system"), F.col("text")).alias("key"), F.substring(F.sha2("text", 256), 1, 12).alias("answer"))
    return adapters.through_cache(calls, known, adapters.Deterministic())[0]


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, turn, role, text, sha256(concat_ws('|', role, 'p', 'm', 's', text)) AS key FROM conversations),
h AS (SELECT DISTINCT key FROM c WHERE turn % 2 = 0 AND role = 'user') SELECT id, key, substring(sha256(text), 1, 12) AS answer, h.key IS NOT NULL AS hit FROM c LEFT JOIN h USING (key)""")
def cached_turns(spark: SparkSession, d: str) -> DataFrame:
    """All turns, those that repeat too; the cache knows what users said at even turns, by one provider."""
    calls = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("user"), F.lit("m").alias("model"), F.lit("s").alias("system"), "text", "turn")
    known = calls.filter("turn % 2 = 0 and user = 'user'").select(adapters.prompt_hash(F.col("user"), F.lit("p"), F.col("model"), F.col("system"), F.col("text")).alias("key"), F.substring(F.sha2("text", 256), 1, 12).alias("answer")).distinct()
    return adapters.through_cache(calls, known, adapters.Deterministic(), "p")[0]
