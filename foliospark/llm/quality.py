"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, after fixed base rules.

Two multinomials over hashed words and word pairs: one of documents labelled good, one of the whole corpus. A document's
score is the mean log ratio of its n-grams, and every document is held against the same threshold. DataFrame functions
only: counting is one aggregation on at most BUCKETS keys, and the table of ratios, of that fixed size, comes back as a
scalar subquery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import texts

BUCKETS = 1 << 16
#: N-grams at the corpus-wide share of trusted ones that each bucket counts beforehand: rare buckets say little, so that a
#: good document without a label isn't held against its own n-grams.
SMOOTHING = 60.0
#: About as many labelled good documents make the trusted multinomial, dealt by a hash of doc_id.
TRUSTED = 20_000
#: Documents of at least this mean log ratio stay.
THRESHOLD = -0.045
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Fewest words, and most per cent of repeated words.
WORDS, REPEATED = 50, 50


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value worked out once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def following(array: Column, by: int) -> Column:
    """The elements after the first `by`."""
    return F.slice(array, F.lit(1 + by), F.greatest(F.size(array) - by, F.lit(0)))


def buckets(w: Column) -> Column:
    """Buckets of all words, and of all pairs of neighbours."""
    pairs = F.zip_with(w, following(w, 1), lambda a, b: F.when(b.isNotNull(), bucket(a, b)))
    return F.concat(F.transform(w, lambda a: bucket(a)), F.filter(pairs, lambda x: x.isNotNull()))


def repeated(w: Column) -> Column:
    """Words that stand in some three-word window that the text has twice or more."""

    def of(windows: Column) -> Column:
        def count(s: Column) -> Column:
            same = F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()
            )
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p, p + 1, p + 2)))))

        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(placed), count))

    n = F.greatest(F.size(w) - 2, F.lit(0))
    hashes = F.zip_with(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, F.lit(3), n), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return let(hashes, of)


def duplicates(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: without(x, WHITE) != ""), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, w (words) and the base counts of texts(docs)."""
    text = F.col("text")
    read = docs.select(
        "doc_id",
        words(text).alias("w"),
        F.length(without(text, WHITE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicates(text).cast("long").alias("n_dup_lines"),
    )
    w = F.col("w")
    return read.select("doc_id", "w", F.size(w).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated(w).cast("long").alias("n_repeat_words"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of good documents, all or about `most` of them."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = min(1.0, most / max(1, good.count()))
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 50)) < int(share * (1 << 50)))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one column: the log ratio of each bucket, as an array of BUCKETS doubles."""
    trusted = trusted_ids(labels).select("doc_id", F.lit(1).alias("good"))
    # at most about TRUSTED rows
    flagged = texts(docs).join(F.broadcast(trusted), "doc_id", "left")
    read = flagged.select(F.coalesce("good", F.lit(0)).alias("good"), words(F.col("text")).alias("w"))
    grams = read.select("good", F.explode(buckets(F.col("w"))).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("good").cast("double").alias("t"), F.count("*").cast("double").alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0.0)
    sums = every.agg(F.sum("t").alias("_t"), F.sum("r").alias("_r"), F.sort_array(F.collect_list(F.struct("b", "t", "r"))).alias("x"))
    share = (F.col("_t") + 1) / (F.col("_r") + 1)
    ratio = lambda x: F.log((x["t"] + SMOOTHING * share) / (x["r"] + SMOOTHING)) - F.log(share)
    return sums.select(F.transform("x", ratio).alias("ratios"))


def mean_ratio(w: Column, table: Column) -> Column:
    def total(t: Column) -> Column:
        each = F.zip_with(w, following(w, 1), lambda a, b: F.get(t, bucket(a)) + F.when(b.isNotNull(), F.get(t, bucket(a, b))).otherwise(F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda x, y: x + y)

    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total(table) / F.greatest(2 * F.size(w) - 1, F.lit(1)))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, log_ratio and kept of each document.

    Null and empty texts have no words and so fail the base rules; rows that repeat stay; without labels all ratios come
    from smoothing alone; an empty table gives no rows; other columns are not read."""
    table = ratios(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels).scalar()
    counted = base(texts(docs, id_col, text_col)).withColumn("_ratios", table).withColumn("log_ratio", mean_ratio(F.col("w"), F.col("_ratios")))
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio")
