"""Plain text as pages of a fixed size, and routing by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.strings import stripped, word_count

PAGE = 3000
# Extensions by reader.
IMAGES = [".png", ".jpg", ".jpeg", ".webp", ".tiff", ".bmp"]
READERS = {"text": [".txt", ".md", ".rtf"], "table": [".csv", ".xlsx", ".xls"], "docx": [".docx"], "layout": [".pdf", *IMAGES]}
#: Fewer words a page than this, on average over the first pages, mean a scan.
SCAN_WORDS, SCAN_PAGES = 50, 3


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def pages_of(text: Column, size: int = PAGE) -> Column:
    """Stripped pages of `size` code points, blank ones dropped."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: stripped(F.substring(text, i * size + 1, F.lit(size))))
    return F.filter(cut, lambda p: p != "")


def paged(docs: DataFrame, size: int = PAGE) -> DataFrame:
    """doc_id, page_num from 1 over the pages that are left, content."""
    return docs.select("doc_id", F.posexplode(pages_of(F.col("text"), size)).alias("p", "content")).select("doc_id", (F.col("p") + 1).alias("page_num"), "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def reader(path: Column) -> Column:
    """The reader of a file by its extension; null if none can handle it."""
    out = F.lit(None).cast("string")
    for name, kinds in READERS.items():
        out = F.when(extension(path).isin(kinds), name).otherwise(out)
    return out


def scanned(pages: DataFrame) -> DataFrame:
    """doc_id, mean_words of its first pages, is_scanned."""
    first = pages.filter(F.col("page_num") <= SCAN_PAGES).groupBy("doc_id").agg(F.round(F.avg(word_count(F.col("content"))), 6).alias("mean_words"))
    return first.withColumn("is_scanned", F.col("mean_words") < SCAN_WORDS)
