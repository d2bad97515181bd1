"""Spelling variants: words one character apart, found by merging the light subtrees of their trie.

Two words that differ by one inserted, deleted or replaced character part at one node of the trie of all words. Below each
node the child with the most words is heavy, all others are light, so a word lies in at most log2(words) light subtrees.
Each light subtree is merged into its node with one character skipped, replaced by the heavy one, or put in before it;
terminals that coincide there are the pairs of which at least one word is light, and light subtrees of one node that are
merged with their first character masked give the rest. A pair is found at the one node where its words part, once.

Nodes are named by 64-bit sums over a prefix: two nodes of one name only share a heavy character, and any choice of it
gives the same pairs. So words of any length cost rows of fixed size in proportion to their length, no node's words ever
meet in one task, and groups of masked words are no larger than the alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget_all, slices, spread, written

#: What a word is made of, fewest code points, and fewest occurrences.
LETTERS, LENGTH, OCCURRENCES = "A-Za-zÀ-ÿ", 7, 2
#: Of the runs of a document one in so many, by a hash, loses a code point before it is counted.
THINNED = 31
#: A form occurs at least so many times as often.
TIMES = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python worker hands on at once.
ROWS = 1 << 16
#: Odd numbers without a pattern, for names of nodes.
MIX, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = OCCURRENCES, thinned: int = THINNED) -> DataFrame:
    """word, n: the runs of letters of whole texts, in lower-case A-Z, `length` code points or more, found `least` times.

    A run whose crc32 with its document's id is a multiple of `thinned` loses one code point; a null id is an empty one. A
    null text has no words; rows that repeat count each; an empty table gives no rows."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
    runs = docs.select(name, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{length},}})"))).alias("_run"))
    plain = F.octet_length("_run") == F.length("_run")
    runs = runs.select("_id", F.when(plain, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat_ws(":", "_id", "_run")).alias("_h"))
    at = F.pmod("_h", F.length("_run")).cast("int")
    shorter = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    found = hashed.select(F.when(F.pmod("_h", F.lit(thinned)) == 0, shorter).otherwise(F.col("_run")).alias("word")).filter(F.length("word") >= length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word and depth the name of the node there and the code point that leads on; 0 after the last one."""
    for b in slices(batches, "word", ROWS * 4):
        n = pc.utf8_length(b.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(b.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
        start = np.cumsum(n + 1) - (n + 1)
        x = np.zeros(int((n + 1).sum()), np.int32)
        x[spread(start, n)] = points
        depth = spread(np.zeros(len(n), np.int64), n + 1)
        with np.errstate(over="ignore"):
            own = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
            own ^= own >> np.uint64(29)
            power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(n.max()), STEP, np.uint64))])
            own *= power[depth]
            before = np.cumsum(own) - own
            node = before - np.repeat(before[start], n + 1)
        cols = [pa.array(np.repeat(b.column("id").to_numpy(), n + 1)), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(x)]
        done = pa.RecordBatch.from_arrays(cols, ["id", "depth", "node", "x"])
        for i in range(0, done.num_rows, ROWS):
            yield done.slice(i, ROWS)


def character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def light(known: DataFrame) -> DataFrame:
    """word, n, depth, c: the light edges of each word of known(id, word, n), with their node's heavy code point."""
    steps = known.select("id", "word").mapInArrow(_steps, "id long, depth int, node long, x int")
    children = steps.groupBy("node", "x").agg(F.count("*").alias("n")).groupBy("node").agg(F.collect_list(F.struct("n", "x")).alias("k"))  # no more than the alphabet has
    branches = children.filter(F.size("k") > 1).select("node", F.array_max("k")["x"].alias("c"), F.explode("k.x").alias("x")).filter("x <> c")
    return steps.join(branches, ["node", "x"]).select("id", "depth", "c").join(known, "id").select("word", "n", "depth", character(F.col("c")).alias("c"))


def neighbours(known: DataFrame, into: list[str] | None = None) -> DataFrame:
    """word, n_near, near_n, near: how many words of known(id, word, n) are one edit away, and which one of them is the most
    frequent, the smallest of equals; words without any are left out. Words and ids are distinct. `into` as by `written`."""
    word, depth = F.col("word"), F.col("depth")
    head, tail, rest, first = F.substr(word, F.lit(1), depth), F.substr(word, depth + 1), F.substr(word, depth + 2), F.substr(word, depth + 1, F.lit(1))
    inside = depth < F.length(word)
    edges = written(light(known), "light", into).select("word", "n", head.alias("head"), "c", rest.alias("rest"), tail.alias("tail"), first.alias("first"), inside.alias("inside"))
    replaced = F.when(F.col("inside"), F.concat("head", "c", "rest"))
    # a run of one letter is left at its end: else its pair would be found at each letter
    skipped = F.when(F.col("inside") & (F.substr("rest", F.lit(1), F.lit(1)) != F.col("first")), F.concat("head", "rest"))
    put_in = F.concat("head", "c", "tail")
    wanted = edges.select("word", "n", F.explode(F.array(replaced, skipped, put_in)).alias("other")).filter("other is not null")
    met = wanted.join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    there = F.struct(F.col("word").alias("word"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w")).alias("best"))
    back = F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")).alias("best"))
    crossing = met.select(F.explode(F.array(there, back)).alias("x")).select("x.word", F.lit(1).cast("long").alias("k"), "x.best")
    masked = edges.filter("inside").groupBy("head", "rest").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")))).alias("g")).filter(F.size("g") > 1)
    among = masked.select(F.posexplode("g").alias("i", "e"), "g").select(F.col("e.w").alias("word"), (F.size("g") - 1).cast("long").alias("k"), F.when(F.col("i") == 0, F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0))).alias("best"))
    stats = crossing.unionByName(among).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return stats.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.w").alias("near"))


def roots(forms: DataFrame, into: list[str]) -> DataFrame:
    """word, root of forms(word, form): the end of its chain. Chains double their reach each round, and are no longer than the
    number of times that a count can grow TIMES-fold."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots", into)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots", into)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus (see `words`).

    A word's form is its near word of largest count, of equal ones the smallest in code-point order, where that is `times`
    its own count or more; else null. Texts that are null or empty, repeated rows and null ids are as in `words`; an empty
    table gives no rows; other columns are not read."""
    spark, scratch = docs.sparkSession, []
    known = written(words(docs, id_col, text_col).withColumn("id", F.monotonically_increasing_id()), "words", scratch)
    near = written(neighbours(known, scratch), "near", scratch)
    kept = F.col("near_n") >= times * F.col("n")
    every = known.select("word", "n").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("near")).alias("form"), F.when(kept, F.col("near_n")).alias("form_n"))
    every = written(every, "forms", scratch)
    ends = roots(every.filter("form is not null"), scratch)
    done = written(every.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    forget_all(spark, scratch)
    return done
