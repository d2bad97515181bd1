"""Hybrid retrieval: cosine and term-frequency scores, reciprocal-rank fusion, de-duplication, context.

Chunks are scored against a batch of queries in one plan. The queries are the small side: a batch is broadcast only up to
QUERIES rows, and beyond that joins by shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.strings import stripped

POOL, TOP, RRF = 500, 5, 60
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Largest batch of queries that is broadcast.
QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """0 where either is zero. norms: the product of both norms where it is known."""
    norms = norm(a) * norm(b) if norms is None else norms
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def small(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if len(queries.take(QUERIES + 1)) <= QUERIES else queries


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def weights(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, term, times, avgdl, idf of the terms of queries(qid, terms) that some chunk has, from chunks(chunk_id, content).
    Rare and common terms weigh by inverse frequency; negative weights become a quarter of the mean weight."""
    words = chunks.select("chunk_id", tokens(F.col("content")).alias("w"))
    totals = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    # the mean weight is over all terms, of which counts alone are shuffled
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(totals)).select("term", "n", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # totals: one row
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    return raw.join(small(terms), "term").crossJoin(F.broadcast(mean)).select("qid", "term", "times", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, sparse for every chunk that has a term of a query. chunks(chunk_id, content), queries(qid, terms):
    a term that a query repeats counts each time."""
    words = chunks.select("chunk_id", tokens(F.col("content")).alias("w"))
    # places of terms are shuffled only for those of queries
    asked = queries.select(F.explode("terms").alias("term")).distinct()
    found = words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(small(asked), "term", "left_semi")
    tf = found.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    scored = tf.join(weights(chunks, queries), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 9).alias("sparse"))


def ranked(scores: DataFrame, by: str, name: str) -> DataFrame:
    """name: place from 0 within a query; ties go to the smaller chunk."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "chunk_id")) - 1)


def placed(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Both scores and ranks of every chunk for each query. chunks(chunk_id, content, vector), queries(qid, terms, qvector)."""
    vectors = chunks.select("chunk_id", "vector", norm(F.col("vector")).alias("norm"))
    asked = small(queries.select("qid", "qvector", norm(F.col("qvector")).alias("qnorm")))
    score = cosine(F.col("vector"), F.col("qvector"), F.col("norm") * F.col("qnorm"))
    dense = vectors.crossJoin(asked).select("qid", "chunk_id", F.round(score, 9).alias("dense"))
    both = dense.join(bm25(chunks, queries), ["qid", "chunk_id"], "left").fillna(0.0, ["sparse"])
    return ranked(ranked(both, "dense", "dense_rank"), "sparse", "sparse_rank")


def hybrid(chunks: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """The `pool` best chunks of each query by both ranks; inputs as in `placed`."""
    fused = placed(chunks, queries).withColumn("rrf", F.round(1.0 / (RRF + 1 + F.col("dense_rank")) + 1.0 / (RRF + 1 + F.col("sparse_rank")), 9))
    best = Window.partitionBy("qid").orderBy(F.desc("rrf"), "chunk_id")
    return fused.withColumn("chunk_num", F.row_number().over(best)).filter(F.col("chunk_num") <= pool)


def merged(lists: DataFrame, top: int = TOP) -> DataFrame:
    """Results of query variants as one list: equal contents once, the first variant and place first, numbered anew.
    lists(qid, variant, chunk_num, content, ...)."""
    first = Window.partitionBy("qid", F.md5("content")).orderBy("variant", "chunk_num")
    order = Window.partitionBy("qid").orderBy("variant", "chunk_num")
    once = lists.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def with_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Content of the parent chunk where there is one. hits(parent_id, content), parents(parent_id, parent_content)."""
    joined = hits.join(parents, "parent_id", "left")
    return joined.withColumn("expanded", F.col("parent_content").isNotNull()).withColumn("content", F.coalesce("parent_content", "content")).drop("parent_content")


def citations(hits: DataFrame) -> DataFrame:
    """qid and its context: [n] (Doc: f, Page p): content, a blank line between."""
    line = F.concat(F.lit("["), F.col("chunk_num").cast("string"), F.lit("] (Doc: "), F.col("file"), F.lit(", Page "), F.col("page").cast("string"), F.lit("): "), F.col("content"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_num", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def evidence(content: Column) -> Column:
    """The first sentence of more than 20 code points, else the first 200 code points."""
    long = F.filter(F.transform(F.split(content, r"\."), stripped), lambda s: F.length(s) > 20)
    return F.coalesce(F.get(long, 0), F.substring(content, 1, 200))


# Words that make a question one about the document.
DOCUMENT_WORDS = ["this", "the document", "the file", "the letter", "the contract", "the invoice", "the report", "the resume", "the agreement", "it says", "mentioned", "above", "here", "uploaded", "about"]


def routed(question: Column, has_document: Column) -> Column:
    """general, document, or unknown where a model would have to tell."""
    hit = F.exists(F.array(*map(F.lit, DOCUMENT_WORDS)), lambda w: F.contains(F.lower(question), w))
    return F.when(~has_document, "general").when(hit, "document").otherwise("unknown")


def mode(text: Column) -> Column:
    m = F.lower(F.trim(text))
    return F.when(m.isin("hyde", "multiquery"), m).otherwise("standard")
