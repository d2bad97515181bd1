"""Contexts of prompts over the driver's tables: documents as chunks of their source's document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import classify, contexts
from foliospark.plans.registry import query
from foliospark.session import load

# five chunks to a document; some documents have children only
CHUNKS = """k AS (SELECT doc_id // 5 AS document_id, doc_id % 5 AS chunk_num, doc_id, text AS content, CASE WHEN doc_id // 5 % 3 = 0 THEN 'child' WHEN doc_id % 4 = 0 THEN 'parent' WHEN doc_id % 4 = 1 THEN 'flat' ELSE 'child' END AS chunk_level, CASE WHEN doc_id % 7 <> 0 THEN e.embedding END AS embedding FROM documents LEFT JOIN embeddings e ON vec_id = doc_id)"""
KINDS = ["text", "figure", "description", "table"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    level = F.when(F.floor(i / 5) % 3 == 0, "child").when(i % 4 == 0, "parent").when(i % 4 == 1, "flat").otherwise("child")
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = load(spark, d, "documents").select("doc_id", "text").join(vectors, "doc_id", "left")
    return both.select(F.floor(i / 5).alias("document_id"), (i % 5).alias("chunk_num"), "doc_id", F.col("text").alias("content"), level.alias("chunk_level"), F.when(i % 7 != 0, F.col("embedding")).alias("embedding"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_level FROM k WHERE chunk_level <> 'parent' AND embedding IS NOT NULL")
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return contexts.searchable(chunks(spark, d)).select("doc_id", "chunk_level")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_level FROM k WHERE chunk_level IN ('parent', 'flat') OR document_id NOT IN (SELECT document_id FROM k WHERE chunk_level IN ('parent', 'flat'))")
def extraction_context(spark: SparkSession, d: str) -> DataFrame:
    return contexts.extraction_chunks(chunks(spark, d)).select("doc_id", "chunk_level")


@query(f"WITH {CHUNKS}, f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_num) <= 3) SELECT document_id, md5(substr(string_agg(content, chr(10) || chr(10) ORDER BY chunk_num), 1, 2000)) AS context FROM f GROUP BY document_id")
def classify_context(spark: SparkSession, d: str) -> DataFrame:
    """The head of each document: its first three chunks here, so that some are left out."""
    return contexts.joined_context(chunks(spark, d), n=3).select("document_id", F.md5("context").alias("context"))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS n, max(chunk_num) AS last FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_num) <= 4) GROUP BY document_id")
def leading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return contexts.leading(chunks(spark, d), 4).groupBy("document_id").agg(F.count("*").alias("n"), F.max("chunk_num").alias("last"))


@query(f"SELECT doc_id, substr(text, 1, 150) AS preview, kind AS chunk_type, CASE WHEN kind <> 'text' THEN 'img' || doc_id END AS image_ref, CASE WHEN kind = 'figure' THEN coalesce(CASE WHEN doc_id % 8 = 1 THEN source END, '') END AS caption, CASE WHEN kind = 'figure' THEN n_chars END AS bbox FROM (SELECT *, {KINDS}[doc_id % 4 + 1] AS kind FROM documents)")
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = load(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.element_at(F.array(*map(F.lit, KINDS)), (i % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("img"), i).alias("image_ref"), F.when(i % 8 == 1, F.col("source")).alias("caption"), F.col("n_chars").alias("bbox"))
    return rows.select("doc_id", *contexts.source(F.col("kind")))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN trim(t) <> '' THEN md5(trim('[Table: ' || CASE WHEN doc_id % 3 = 0 THEN 'untitled' ELSE source END || ']' || chr(10) || t, ' ' || chr(10))) END ELSE CASE WHEN trim(t, ' ' || chr(10)) <> '' THEN md5('[Visual Description — Page ' || (doc_id % 9) || ']: ' || trim(t, ' ' || chr(10))) END END AS content,
CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'description' END AS chunk_type, (doc_id % 9)::VARCHAR AS page, 'flat' AS chunk_level FROM (SELECT *, regexp_replace(substr(text, 1, 200), '[^a-zA-Z ]', ' ', 'g') AS t FROM documents)""")
def described_chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = load(spark, d, "documents").select("doc_id", "source", F.regexp_replace(F.substring("text", 1, 200), "[^a-zA-Z ]", " ").alias("t"))
    table = contexts.table_chunk(F.when(i % 6 == 0, "").when(i % 3 != 0, F.col("source")), F.col("t"))
    kind = F.when(i % 2 == 0, "table").otherwise("description")
    made = rows.select("doc_id", F.md5(F.when(i % 2 == 0, table).otherwise(contexts.description_chunk(i % 9, F.col("t")))).alias("content"), contexts.flat_metadata(i % 9, F.col("source"), kind, F.lit(None).cast("string")).alias("m"))
    return made.select("doc_id", "content", "m.chunk_type", "m.page", "m.chunk_level")


@query("SELECT event_id, lower(event_type) AS doc_type, value / 100 AS confidence, value / 100 < 0.4 AS requires_human_review, 'stage2' AS stage_used FROM events WHERE event_type IS NOT NULL")
def normalised_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").filter("event_type is not null")
    return rows.select("event_id", *contexts.normalised(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  ")), F.col("value") / 100, 0.4))


@query("SELECT doc_id, source AS doc_type, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE source END AS schema_template, 1.0 AS confidence, true AS manually_overridden, false AS requires_human_review, lang AS reasoning FROM documents")
def overridden_types(spark: SparkSession, d: str) -> DataFrame:
    was = F.struct(F.lit("general").alias("doc_type"), F.lit(0.2).alias("confidence"), F.col("lang").alias("reasoning"))
    now = load(spark, d, "documents").select("doc_id", contexts.overridden(was, F.col("source"), F.when(F.col("doc_id") % 2 == 0, "own")).alias("c"))
    return now.select("doc_id", "c.*")


TYPES = [*classify.HIERARCHICAL[:3], "invoice", "general"]


@query(f"SELECT doc_id, CASE WHEN {TYPES}[doc_id % 5 + 1] IN ('contract', 'agreement', 'nda', 'loan_application', 'legal_document', 'court_filing', 'research_paper', 'report') THEN 'hierarchical' ELSE 'flat' END AS mode FROM documents")
def chunk_modes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.when(kind.isin(classify.HIERARCHICAL), "hierarchical").otherwise("flat").alias("mode"))


@query("SELECT doc_id, (at_ - 1) // 700 * 700 AS page_start, (at_ - 1) // 700 + 1 AS page FROM (SELECT doc_id, instr(text, ' de ') AS at_ FROM documents) WHERE at_ > 0")
def page_of_match(spark: SparkSession, d: str) -> DataFrame:
    """An as-of lookup in a document's own page offsets: the last one at or before a place."""
    at = F.instr("text", " de ") - 1
    rows = load(spark, d, "documents").select("doc_id", at.alias("x"), F.sequence(F.lit(0), F.length("text"), F.lit(700)).alias("offsets")).filter("x >= 0")
    before = F.filter("offsets", lambda o: o <= F.col("x"))
    return rows.select("doc_id", F.array_max(before).cast("long").alias("page_start"), F.size(before).cast("long").alias("page"))


@query("SELECT source, sum(len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r\\f\\x0B]+'), lambda x: x <> ''))) AS words, count(*) AS pages, count_if(contains(text, '|')) AS tables FROM documents GROUP BY source")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[ \n\t\r\f\x0B]+"), lambda x: x != ""))
    return load(spark, d, "documents").groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("pages"), F.count_if(F.contains(F.col("text"), F.lit("|"))).alias("tables"))


@query("""WITH r AS (SELECT l_suppkey AS doc_type, l_linenumber AS f, l_orderkey AS id, CASE WHEN l_tax > 0.01 THEN l_linestatus ELSE '' END AS original, CASE WHEN l_discount > 0.04 THEN l_returnflag ELSE l_linestatus END AS corrected, l_shipdate FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 5),
n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_type, f ORDER BY l_shipdate DESC, id) <= 3),
p AS (SELECT doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY f, l_shipdate DESC, id) AS place, 'field_' || f AS field, original, corrected FROM n WHERE original <> '' AND corrected <> '' AND original <> corrected)
SELECT * FROM p WHERE place <= 5""")
def correction_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as types of documents, lines of an order as fields, of which seven are asked for and five count."""
    flag = F.col("l_returnflag")
    rows = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("doc_type"), F.concat(F.lit("field_"), "l_linenumber").alias("field"), F.when(F.col("l_tax") > 0.01, F.col("l_linestatus")).otherwise("").alias("original"),
        F.when(F.col("l_discount") > 0.04, flag).otherwise(F.col("l_linestatus")).alias("corrected"), F.when(flag != "N", "correct").otherwise("keep").alias("action"), F.col("l_shipdate").alias("created_at"),
    )
    return contexts.correction_examples(rows, [f"field_{i}" for i in range(1, 8)]).withColumn("place", F.col("place").cast("long"))


@query(r"""SELECT doc_id, doc_id % 6 <> 5 AND (doc_id % 6 = 1 OR doc_id % 7 = 0 OR source = 'src3' OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 50) AS vision FROM documents""")
def vision_pages(spark: SparkSession, d: str) -> DataFrame:
    """One file of six is a picture, one of seven a scan, and one of six has no provider; documents of one source stand for a type that pictures carry."""
    i = F.col("doc_id")
    path = F.concat(F.lit("f/"), i.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".docx", ".txt", ".pdf", ".jpg"))), (i % 6 + 1).cast("int")))
    kind = F.when(F.col("source") == "src3", "id_document").otherwise("invoice")
    return load(spark, d, "documents").select("doc_id", classify.needs_vision(path, F.col("text"), i % 7 == 0, kind, F.when(i % 6 != 5, "some")).alias("vision"))


@query("SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS number FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests, their orders as a shortlist, lines as criteria; lines that weren't returned have no snippet."""
    from foliospark.operators import records

    o = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("snippet"))
    rows = lines.join(o, "l_orderkey").select("*", F.col("l_orderkey").alias("rank"), F.col("l_linenumber").alias("criterion_pos"))
    return records.cited(rows, "o_custkey").select("o_custkey", "l_orderkey", "l_linenumber", F.col("number").cast("long").alias("number"))
