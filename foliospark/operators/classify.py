"""Document types: signals, exemplars, a gate, and templates."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.entities import let
from foliospark.functions.strings import stripped, word_count
from foliospark.operators.retrieval import cosine, norm
from foliospark.sources.text import IMAGES, extension

HEAD, SPREAD, GATE = 500, 0.3, 0.75
#: Most exemplars that are held against every document.
EXEMPLARS = 64
# Phrases by document type.
SIGNALS = {
    "invoice": ["invoice no", "invoice number", "bill to", "total amount due", "tax invoice", "gst invoice", "invoice date", "payment due", "subtotal", "amount payable"],
    "receipt": ["receipt no", "receipt number", "amount paid", "payment received", "cash receipt", "transaction id", "paid by"],
    "purchase_order": ["purchase order", "po number", "po no", "order number", "delivery address", "ship to", "vendor"],
    "bank_statement": ["account number", "account no", "statement period", "opening balance", "closing balance", "transaction date", "available balance", "ifsc", "sort code", "routing number"],
    "cv_resume": ["curriculum vitae", "resume", "work experience", "employment history", "education", "skills", "objective", "career summary", "professional experience", "references available"],
    "contract": ["this agreement", "whereas", "hereinafter referred to", "terms and conditions", "governing law", "in witness whereof", "indemnification", "termination clause", "force majeure"],
    "nda": ["non-disclosure", "confidentiality agreement", "confidential information", "disclosing party", "receiving party", "trade secret"],
    "loan_application": ["loan application", "applicant name", "loan amount", "loan purpose", "monthly income", "credit score", "collateral", "emi", "rate of interest", "repayment period"],
    "gst_return": ["gstr", "gst return", "gstin", "outward supplies", "inward supplies", "input tax credit", "integrated tax", "central tax", "state tax"],
    "offer_letter": ["offer letter", "job offer", "compensation package", "start date", "position offered", "reporting to", "ctc"],
    "medical": ["patient name", "date of birth", "diagnosis", "prescription", "dosage", "physician", "medical record", "icd", "rx"],
    "legal": ["plaintiff", "defendant", "court of", "whereas", "petitioner", "respondent", "affidavit", "hereby ordered", "jurisdiction"],
    "id_document": ["date of birth", "date of issue", "date of expiry", "nationality", "passport no", "driving licence", "aadhaar", "pan card", "voter id", "national id"],
}
# Templates by document type; any other has none of its own.
TEMPLATES = {
    "invoice": "invoice", "receipt": "invoice", "bill": "invoice", "purchase order": "invoice",
    "resume": "cv_resume", "cv": "cv_resume", "curriculum vitae": "cv_resume",
    "contract": "contract", "agreement": "contract", "nda": "contract", "mou": "contract", "memorandum of understanding": "contract",
    "financial statement": "bank_statement", "balance sheet": "bank_statement", "income statement": "bank_statement", "bank statement": "bank_statement", "profit and loss": "bank_statement",
    "gst return": "gst_return", "gstr-1": "gst_return", "gstr-3b": "gst_return", "tax return": "gst_return",
    "offer letter": "offer_letter", "appointment letter": "offer_letter", "employment contract": "offer_letter",
    "loan application": "loan_application", "credit application": "loan_application", "mortgage application": "loan_application",
    "report": "general", "research paper": "general", "annual report": "general", "medical record": "general", "prescription": "general", "legal document": "general", "court filing": "general",
    "article": "custom", "email": "custom", "letter": "custom", "general": "custom",
}
# Types that are chunked by parents and children; types where pictures carry the content.
HIERARCHICAL = ["contract", "agreement", "nda", "loan_application", "legal_document", "court_filing", "research_paper", "report"]
VISUAL = ["construction_photo", "id_document"]


def signal_scores(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type, score: the share of a type's phrases that the first code points hold."""
    spark: SparkSession = docs.sparkSession
    rows = spark.createDataFrame([(t, s, len(x)) for t, x in SIGNALS.items() for s in x], "doc_type string, signal string, n int")
    kinds = F.broadcast(rows.groupBy("doc_type").agg(F.collect_list("signal").alias("signals"), F.first("n").alias("n")))  # a fixed table
    head = F.lower(F.substring("text", 1, HEAD))
    hits = F.size(F.filter("signals", lambda s: F.contains(F.col("head"), s)))
    return docs.select("doc_id", head.alias("head")).crossJoin(kinds).select("doc_id", "doc_type", F.round(hits / F.col("n"), 9).alias("score"))


def decided(keyword: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_type, confidence: both scores by halves, the lead of the best over the second; general without lead. A
    score that is missing counts 0, as all of one kind do where there is no table of them."""
    both = keyword.withColumnRenamed("score", "k")
    both = both.join(embedding.withColumnRenamed("score", "e"), ["doc_id", "doc_type"], "full") if embedding is not None else both.withColumn("e", F.lit(0.0))
    total = both.select("doc_id", "doc_type", (0.5 * F.coalesce("k", F.lit(0.0)) + 0.5 * F.coalesce("e", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "doc_type")
    best = total.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("n = 1")
    lead = F.when(F.col("score") <= 0, 0.0).otherwise(F.round(F.least((F.col("score") - F.coalesce("second", F.lit(0.0))) / SPREAD, F.lit(1.0)), 3))
    return best.select("doc_id", F.when(lead == 0, "general").otherwise(F.col("doc_type")).alias("doc_type"), lead.alias("confidence"))


def stage1(docs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """doc_id, doc_type, confidence of docs(doc_id, text, embedding), as `decided` has them of phrases and of the cosine with
    exemplars(doc_type, embedding), one a type. A type that has no phrases, or no exemplar, counts 0 for that half, and so does
    a null vector. Blank and null texts are general. Repeated rows stay. No document moves: the exemplars, EXEMPLARS at most
    (more are refused), go along as one row; those of a null type don't count."""
    exemplars = exemplars.filter("doc_type is not null")
    if len(exemplars.select("doc_type").take(EXEMPLARS + 1)) > EXEMPLARS:
        raise ValueError(f"more than {EXEMPLARS} exemplars")
    one = exemplars.agg(F.collect_list(F.struct("doc_type", "embedding", norm(F.col("embedding")).alias("norm"))).alias("_exemplars"))
    held = docs.select("doc_id", "text", "embedding").crossJoin(F.broadcast(one))
    head = F.lower(F.substring("text", 1, HEAD))
    said = lambda t: F.round(sum(F.contains(F.col("_head"), F.lit(s)).cast("int") for s in SIGNALS[t]) / len(SIGNALS[t]), 9)
    near = let(norm(F.col("embedding")), lambda n: F.transform("_exemplars", lambda e: F.struct(e["doc_type"], F.round(cosine(F.col("embedding"), e["embedding"], n * e["norm"]), 9))))
    halves = held.withColumn("_head", head).withColumn("_k", F.create_map(*(x for t in SIGNALS for x in (F.lit(t), said(t))))).withColumn("_e", F.map_from_entries(near))
    half = lambda of, t: 0.5 * F.coalesce(F.try_element_at(of, t), F.lit(0.0))
    every = F.array_union(F.map_keys("_k"), F.map_keys("_e"))
    ranked = F.array_sort(F.transform(every, lambda t: F.struct((0.0 - (half(F.col("_k"), t) + half(F.col("_e"), t))).alias("less"), t.alias("doc_type"))))
    best, second = -F.col("_r")[0]["less"], -F.coalesce(F.get("_r", 1)["less"], F.lit(0.0))
    lead = F.when((best <= 0) | F.coalesce(stripped(F.col("text")) == "", F.lit(True)), 0.0).otherwise(F.round(F.least((best - second) / SPREAD, F.lit(1.0)), 3))
    done = halves.select("doc_id", "text", ranked.alias("_r")).select("doc_id", F.col("_r")[0]["doc_type"].alias("doc_type"), lead.alias("confidence"))
    return done.withColumn("doc_type", F.when(F.col("confidence") == 0, "general").otherwise(F.col("doc_type")))


def template(doc_type: Column) -> Column:
    known = F.create_map(*map(F.lit, chain(*TEMPLATES.items())))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(doc_type))), F.lit("custom"))


def stage(confidence: Column) -> Column:
    return F.when(confidence >= GATE, "stage1").otherwise("stage2")


def needs_vision(path: Column, text: Column, is_scanned: Column, doc_type: Column, provider: Column, least: int = 50) -> Column:
    """Whether a model is to look at a page: one is there, and the file is a picture, a scan, of a type that pictures carry, or
    has fewer than `least` words. Nulls count as no."""
    few = word_count(F.coalesce(text, F.lit(""))) < least
    wanted = [extension(path).isin(IMAGES), is_scanned, doc_type.isin(VISUAL), few]
    return reduce(lambda a, b: a | b, (F.coalesce(w, F.lit(False)) for w in wanted)) & (F.coalesce(provider, F.lit("")) != "")
