"""Word documents made of the driver's documents, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import load
from foliospark.sources import docx
from foliospark.sources.content import SPACE

TRIM = rf"regexp_replace({{}}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
BODY = f"""b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIM.format('l')}), lambda l: l <> '')
 || ['doc_id | lang | source', concat_ws(' | ', doc_id, nullif({TRIM.format('lang')}, ''), nullif({TRIM.format('source')}, '')), 'n_chars | ' || n_chars, 'no | header'], chr(10) || chr(10)) AS body FROM documents)"""


def word_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document as paragraphs; a table of three rows, one with a blank cell; a table whose first row is blank."""
    said = lambda *c: F.array(*(F.col(x).cast("string") if x else F.lit(" ") for x in c))
    head = F.array(*map(F.lit, ("doc_id", "lang", "source")))
    first = F.array(head, said("doc_id", "lang", "source"), F.array(F.lit("n_chars"), F.lit(None), F.col("n_chars").cast("string")))
    second = F.array(said(None, None), F.array(F.lit("no"), F.lit("header")))
    docs = load(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docx.parsed(docs.select("doc_id", docx.packed(F.split("text", "\n"), F.array(first, second)).alias("content")))


@query(rf"""WITH {BODY}, p AS (SELECT doc_id, i, {TRIM.format('substr(body, i + 1, 3000)')} AS t FROM (SELECT doc_id, body, unnest(range(0, length(body), 3000)) AS i FROM b))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page_num, md5(t) AS page, len(regexp_split_to_array(t, '[{SPACE}]+')) AS words, 'chunk' AS position_type FROM p WHERE t <> ''""")
def word_pages(spark: SparkSession, d: str) -> DataFrame:
    return docx.pages(word_files(spark, d)).select("doc_id", F.col("page_num").cast("long").alias("page_num"), F.md5("text").alias("page"), F.col("words").cast("long").alias("words"), "position_type")


@query(f"""SELECT doc_id, 1 AS table_num, 'doc_id,lang,source' AS headers, 2 AS n_rows, 'doc_id | lang | source' || chr(10) || concat_ws(' | ', doc_id, nullif({TRIM.format('lang')}, ''), nullif({TRIM.format('source')}, '')) || chr(10) || 'n_chars | ' || n_chars AS raw_text FROM documents""")
def word_tables(spark: SparkSession, d: str) -> DataFrame:
    return docx.tables(word_files(spark, d)).select("doc_id", "table_num", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("n_rows"), "raw_text")
