"""A corpus pipeline: each stage is one operator, works on all that the stage before it kept, and is written out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs,
but for the last, which returns packed pieces. Nulls, empty texts and repeated rows pass as the operators say; columns
beyond doc_id, text and n_chars pass untouched, and n_chars follows the text where it is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from foliospark.llm.common import forget_all, table, written
from foliospark.llm.queries import tokenizer

#: Words of a shingle, and per cent of the union that near duplicates share. Those of op7_ngram_join bind that query alone.
NEAR_WORDS, NEAR_SHARE = 5, 80


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like`, and n_chars of the new text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from labelled documents that aren't held out; without
    labels of both kinds nothing is rejected. Null and empty texts and repeated rows are scored each; an empty table gives
    no rows."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for those of one document; every document stays, if
    with an empty text. A null text stays null; an empty table gives no rows; columns of any name pass."""
    return _recounted(line_dedup.dedup(docs), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one of the smallest doc_id stays, and of rows equal in doc_id and text one. Null
    and empty texts are near nothing: all of them stay. An empty table gives no rows."""
    return ngram_join.representatives(docs, words=NEAR_WORDS, share=NEAR_SHARE)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays, repeated rows each; null texts stay null; an empty table
    gives no rows."""
    return _recounted(secret_scan.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences; null and empty texts and repeated rows are documents each; an
    empty table gives no rows."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean),
    ("line_dedup", without_boilerplate),
    ("ngram_join", one_of_each),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: No stage is held against SQL. Tests hold the near duplicates against all pairs, and line dedup against a plain fold as an
#: operator; of the toxicity and secret stages in the pipeline they check rows and columns only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again; a table goes once the next
    one is there."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        now: list[str] = []
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", now)
        forget_all(spark, read)
        read = now
    done = STAGES[-1][1](spark, docs, sf_dir)  # pieces are a table already, so nothing reads the last stage again
    forget_all(spark, read)
    return done
