"""Retrieval and classification over documents, embeddings, conversations and benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import classify, fusion, places, retrieval
from foliospark.plans.registry import query
from foliospark.session import load
from foliospark.sources.text import paged

#: Chunk ids are doc_id times this, plus the page.
PER_DOC = 10_000

CHUNKS = r"""
pages AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1)::INT AS page_num FROM (
  SELECT doc_id, list_filter(list_transform(range(0, CAST(ceil(length(text) / 3000.0) AS INT) + 1), lambda i: regexp_replace(substring(text, i * 3000 + 1, 3000), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)),
chunks AS (SELECT doc_id, doc_id * 10000 + page_num AS chunk_id, page_num, content FROM pages)"""

SCORES = (
    CHUNKS
    + r""",
nv AS (SELECT count(*) AS n FROM embeddings),
cv AS (SELECT c.*, e.embedding::DOUBLE[] AS vector FROM chunks c, nv JOIN embeddings e ON e.vec_id = c.doc_id % nv.n),
q AS (SELECT e.vec_id AS qid, e.embedding::DOUBLE[] AS qvector, list_slice(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda t: t <> ''), 1, 6) AS terms FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 100 = 0),
dense AS (SELECT qid, chunk_id, page_num, content, round(list_cosine_similarity(vector, qvector), 9) AS dense FROM cv, q),
words AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda t: t <> '') AS w FROM chunks),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
mi AS (SELECT avg(idf) AS m FROM raw),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(terms) AS term FROM q) GROUP BY ALL),
wt AS (SELECT qid, term, times, avgdl, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM qt JOIN raw USING (term), mi),
sparse AS (SELECT qid, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS sparse FROM tf JOIN wt USING (term) GROUP BY ALL),
both_ AS (SELECT d.*, coalesce(s.sparse, 0.0) AS sparse FROM dense d LEFT JOIN sparse s USING (qid, chunk_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, chunk_id) - 1 AS dr, row_number() OVER (PARTITION BY qid ORDER BY sparse DESC, chunk_id) - 1 AS sr FROM both_),
fz AS (SELECT *, round(1.0::DOUBLE / (61 + dr) + 1.0::DOUBLE / (61 + sr), 9) AS rrf FROM rk),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS chunk_num FROM fz)"""
)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return paged(load(spark, d, "documents")).withColumn("chunk_id", F.col("doc_id") * PER_DOC + F.col("page_num"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries: vectors whose id is divisible by 100, with the first words of the document of that id."""
    vectors = load(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0)
    text = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.slice(retrieval.tokens(F.col("text")), 1, 6).alias("terms"))
    return vectors.join(text, "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"), "terms")


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.count()
    return chunks(spark, d).withColumn("vec_id", F.col("doc_id") % n).join(vectors, "vec_id")


@query(f"WITH {SCORES} SELECT qid, chunk_id, dense, sparse, rrf, chunk_num FROM hy WHERE chunk_num <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.searched(with_vectors(spark, d), asked(spark, d), retrieval.TOP)
    return found.select("qid", "chunk_id", "dense", "sparse", "rrf", F.col("chunk_num").cast("long").alias("chunk_num"))


@query(f"WITH {SCORES} SELECT qid, chunk_id, rrf, chunk_num FROM hy WHERE chunk_num <= 500")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """The whole pool of 500 that a reranker would get."""
    found = fusion.searched(with_vectors(spark, d), asked(spark, d))
    return found.select("qid", "chunk_id", "rrf", F.col("chunk_num").cast("long").alias("chunk_num"))


OPEN = "(SELECT c.* FROM chunks c JOIN documents d USING (doc_id) WHERE d.lang = 'en')"


@query(f"WITH {SCORES.replace('FROM chunks c, nv', f'FROM {OPEN} c, nv').replace('FROM chunks),', f'FROM {OPEN}),')} SELECT qid, chunk_id, rrf, chunk_num FROM hy WHERE chunk_num <= 5")
def search_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Search in the documents that are open, here those of one language: others count neither as results nor in the weights
    of terms."""
    wanted = load(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    found = fusion.searched(with_vectors(spark, d), asked(spark, d), top=retrieval.TOP, document_ids=wanted)
    return found.select("qid", "chunk_id", "rrf", F.col("chunk_num").cast("long").alias("chunk_num"))


@query(f"WITH {SCORES} SELECT qid, chunk_id, sparse FROM sparse")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return fusion.term_scores(chunks(spark, d), asked(spark, d))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS place FROM s)
SELECT qid, vec_id, score, place FROM r WHERE place <= 10""")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings")
    q = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"))
    s = fusion.neighbours(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), q, 10, 6)
    return s.select("qid", F.col("chunk_id").alias("vec_id"), "score", F.col("place").cast("long").alias("place"))


VARIANTS = f"""{SCORES}, v AS (
  SELECT qid, 0 AS variant, row_number() OVER (PARTITION BY qid ORDER BY dr) AS chunk_num, chunk_id, content FROM hy WHERE dr < 10
  UNION ALL SELECT qid, 1, row_number() OVER (PARTITION BY qid ORDER BY sr), chunk_id, content FROM hy WHERE sr < 10),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, md5(content) ORDER BY variant, chunk_num) AS n FROM v),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY variant, chunk_num) AS place FROM o WHERE n = 1)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Two variants of each query: nearest vectors, and best terms."""
    best = fusion.first_of_either(with_vectors(spark, d), asked(spark, d), 10)
    all_ = best.join(chunks(spark, d).select("chunk_id", "content", "page_num"), "chunk_id")
    one = lambda n, c: all_.filter(F.col(c) < 10).select("qid", F.lit(n).alias("variant"), (F.col(c) + 1).alias("chunk_num"), "chunk_id", "content", "page_num")
    return one(0, "dense_rank").unionByName(one(1, "sparse_rank"))


@query(f"WITH {VARIANTS} SELECT qid, chunk_id, place FROM m WHERE place <= 5")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merged(variants(spark, d)).select("qid", "chunk_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {SCORES}, c AS (SELECT qid, chunk_num, '[' || chunk_num || '] (Doc: d' || (chunk_id // 10000) || ', Page ' || page_num || '): ' || content AS line FROM hy WHERE chunk_num <= 5)
SELECT qid, md5(string_agg(line, chr(10) || chr(10) ORDER BY chunk_num)) AS context FROM c GROUP BY qid""")
def citation_context(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.searched(with_vectors(spark, d), asked(spark, d), retrieval.TOP).select("qid", "chunk_id", "chunk_num")
    hits = best.join(chunks(spark, d), "chunk_id").select("qid", "chunk_num", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("page_num").alias("page"), "content")
    return retrieval.citations(hits).withColumn("context", F.md5("context"))


@query(rf"""WITH {CHUNKS}, s AS (SELECT chunk_id, list_filter(list_transform(string_split(content, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS l, content FROM chunks)
SELECT chunk_id, coalesce(l[1], substring(content, 1, 200)) AS evidence FROM s""")
def evidence_sentence(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", retrieval.evidence(F.col("content")).alias("evidence"))


@query(f"""WITH {CHUNKS}, p AS (SELECT doc_id * 10000 + (page_num // 2) AS parent_id, string_agg(content, ' ' ORDER BY page_num) AS parent_content FROM chunks GROUP BY ALL HAVING count(*) > 1)
SELECT chunk_id, parent_content IS NOT NULL AS expanded, md5(coalesce(parent_content, content)) AS content FROM chunks LEFT JOIN p ON parent_id = doc_id * 10000 + (page_num // 2)""")
def parent_expansion(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("parent_id", F.col("doc_id") * PER_DOC + F.floor(F.col("page_num") / 2))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "content"))), lambda x: x["content"]), " ")
    parents = c.groupBy("parent_id").agg(F.count("*").alias("n"), joined.alias("parent_content")).filter("n > 1").drop("n")
    return retrieval.with_parents(c, parents).select("chunk_id", "expanded", F.md5("content").alias("content"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg(role || ': ' || substring(text, 1, 300), chr(10) ORDER BY turn) FILTER (r <= 4) AS history, max(n) >= 10 AS compress, count(*) FILTER (r > 4) AS older FROM o GROUP BY conv_id""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    o = load(spark, d, "conversations").withColumn("r", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("n", F.count("*").over(w))
    line = F.concat("role", F.lit(": "), F.substring("text", 1, 300))
    return o.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 4, F.struct("turn", line.alias("line"))))), lambda x: x["line"]), "\n").alias("history"),
        (F.max("n") >= 10).alias("compress"), F.count_if(F.col("r") > 4).alias("older"),
    )


QUOTED = "[" + ", ".join("'" + w + "'" for w in retrieval.DOCUMENT_WORDS) + "]"


@query(f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'general' WHEN len(list_filter({QUOTED}, lambda w: contains(lower(text), w))) > 0 THEN 'document' ELSE 'unknown' END AS route FROM conversations""")
def question_routing(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", retrieval.routed(F.col("text"), F.col("role") != "system").alias("route"))


KINDS = " UNION ALL ".join(f"SELECT '{t}' AS doc_type, [{', '.join(chr(39) + s + chr(39) for s in x)}] AS signals" for t, x in classify.SIGNALS.items())
CLASSIFIED = f"""kinds AS ({KINDS}), sc AS (SELECT doc_id, doc_type, round(len(list_filter(signals, lambda s: contains(lower(substring(text, 1, 500)), s))) / len(signals)::DOUBLE, 9) AS score FROM documents, kinds),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, doc_type) AS n, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, doc_type) AS second FROM sc),
de AS (SELECT doc_id, doc_type, CASE WHEN score <= 0 THEN 0.0 ELSE round(least((0.5 * score - 0.5 * second) / 0.3, 1.0), 3) END AS confidence FROM rk WHERE n = 1)"""


@query(f"WITH {CLASSIFIED} SELECT doc_id, CASE WHEN confidence = 0 THEN 'general' ELSE doc_type END AS doc_type, confidence, CASE WHEN confidence >= 0.75 THEN 'stage1' ELSE 'stage2' END AS stage FROM de")
def keyword_classification(spark: SparkSession, d: str) -> DataFrame:
    return classify.decided(classify.signal_scores(load(spark, d, "documents"))).withColumn("stage", classify.stage(F.col("confidence")))


TEMPLATED = "CASE lower(trim(x)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.TEMPLATES.items()) + " ELSE 'custom' END"


@query(f"SELECT p_partkey, {TEMPLATED.replace('(x)', '(list_extract(l, (p_partkey % len(l) + 1)::INT))')} AS template FROM part, (SELECT [{', '.join(chr(39) + k.upper() + ' ' + chr(39) for k in [*classify.TEMPLATES, 'other'])}] AS l)")
def template_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(k.upper() + " ") for k in [*classify.TEMPLATES, "other"]))
    return load(spark, d, "part").select("p_partkey", classify.template(F.get(names, (F.col("p_partkey") % F.size(names)).cast("int"))).alias("template"))


@query("SELECT conv_id, turn, CASE WHEN lower(trim(m)) IN ('hyde', 'multiquery') THEN lower(trim(m)) ELSE 'standard' END AS mode FROM (SELECT *, list_extract([' HyDE', 'multiquery', 'none', '', NULL], (turn % 5 + 1)::INT) AS m FROM conversations)")
def retrieval_mode(spark: SparkSession, d: str) -> DataFrame:
    m = F.get(F.array(F.lit(" HyDE"), F.lit("multiquery"), F.lit("none"), F.lit(""), F.lit(None).cast("string")), (F.col("turn") % 5).cast("int"))
    return load(spark, d, "conversations").select("conv_id", "turn", retrieval.mode(m).alias("mode"))


@query(f"""WITH {CHUNKS} SELECT doc_id, page_num, content FROM chunks""")
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "page_num", "content")


@query(rf"""WITH {CHUNKS}, m AS (SELECT doc_id, round(avg(len(regexp_split_to_array(content, '\s+'))), 6) AS mean_words FROM chunks WHERE page_num <= 3 GROUP BY doc_id)
SELECT doc_id, mean_words, mean_words < 50 AS is_scanned FROM m""")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    from foliospark.sources.text import scanned

    return scanned(chunks(spark, d))


WANTED = r"v AS (SELECT item_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS v FROM benchmark), w AS (SELECT * FROM v WHERE length(v) >= 4)"


def values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("value_id"), F.col("text").alias("value"))


@query(f"WITH {WANTED} SELECT item_id, d.doc_id, instr(lower(d.text), v) - 1 AS \"at\" FROM w JOIN documents d ON contains(lower(d.text), v)")
def value_position(spark: SparkSession, d: str) -> DataFrame:
    """Where each whole value stands first in each document that has it: all items against all documents."""
    docs = load(spark, d, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("").alias("bbox"))
    return places.places(docs, values(spark, d)).select(F.col("value_id").alias("item_id"), "doc_id", "at")


@query(f"""WITH {CHUNKS}, {WANTED}, m AS (SELECT item_id, doc_id, chunk_id, page_num, instr(lower(content), v) - 1 AS x FROM w JOIN chunks ON contains(lower(content), v) WHERE page_num % 4 <> 0)
SELECT item_id, doc_id, min(x) AS "at", arg_min(chunk_id, (x, chunk_id)) AS chunk_id, 'page ' || arg_min(page_num, (x, chunk_id)) AS bbox FROM m GROUP BY item_id, doc_id""")
def value_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The place on a page of each value in each document: of its chunks with a place, the one where it stands earliest."""
    placed = chunks(spark, d).withColumn("bbox", F.when(F.col("page_num") % 4 != 0, F.concat(F.lit("page "), F.col("page_num").cast("string"))))
    return places.places(placed, values(spark, d)).withColumnRenamed("value_id", "item_id")


#: Types of the exemplars, by label; the last two have no phrases.
EXEMPLARS = [*list(classify.SIGNALS)[:8], "report", "article"]


@query(f"""WITH kinds AS ({KINDS}), v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS a FROM embeddings), ex AS (SELECT {EXEMPLARS}[label + 1] AS doc_type, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label < 10 GROUP BY label)),
t AS (SELECT doc_type FROM kinds UNION SELECT doc_type FROM ex),
k AS (SELECT doc_id, doc_type, round(len(list_filter(signals, lambda s: contains(lower(substring(text, 1, 500)), s))) / len(signals)::DOUBLE, 9) AS k FROM documents, kinds),
e AS (SELECT doc_id, doc_type, round(list_cosine_similarity(a, b), 9) AS e FROM v, ex),
s AS (SELECT d.doc_id, t.doc_type, 0.5::DOUBLE * coalesce(k, 0.0::DOUBLE) + 0.5::DOUBLE * coalesce(e, 0.0::DOUBLE) AS s FROM documents d CROSS JOIN t LEFT JOIN k USING (doc_id, doc_type) LEFT JOIN e USING (doc_id, doc_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, doc_type) AS n, lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, doc_type) AS second FROM s),
f AS (SELECT doc_id, doc_type, CASE WHEN s <= 0 OR trim(text) = '' THEN 0.0 ELSE round(least((s - second) / 0.3, 1.0), 3) END AS confidence FROM r JOIN documents USING (doc_id) WHERE n = 1)
SELECT doc_id, CASE WHEN confidence = 0 THEN 'general' ELSE doc_type END AS doc_type, confidence, CASE WHEN confidence >= 0.75 THEN 'stage1' ELSE 'stage2' END AS stage FROM f""")
def exemplar_classification(spark: SparkSession, d: str) -> DataFrame:
    """Phrases and vectors by halves; the first vector of each of the first ten labels is a type's exemplar."""
    v = load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    first = v.filter("label < 10").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    exemplars = first.select(F.get(F.array(*map(F.lit, EXEMPLARS)), F.col("label")).alias("doc_type"), "embedding")
    docs = load(spark, d, "documents").select("doc_id", "text").join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return classify.stage1(docs, exemplars).withColumn("stage", classify.stage(F.col("confidence")))
