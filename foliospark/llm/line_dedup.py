"""Line dedup by a log-template tree, with DataFrame functions only.

A line falls to a leaf by its number of words and its first words; words with digits are fields, and read <*>. Within a
leaf, lines that agree in most positions with the leaf's first line share its template, where the other positions are
fields; the rest look for the first line among themselves, and so on until no line is left. A round finds several first
lines at once, by a fold over the first lines of each leaf. What a leaf has left after some rounds are mostly lines of
nothing in common, and those are held only against lines that share a block of positions with them, which all lines that
agree in enough positions do. Of a template that several documents have, the lines of the
smallest doc_id stay and those of all other documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import forget_all, written

#: Leading words on the path to a leaf.
DEPTH = 3
#: Lines of fewer words stay. From VARIABLE words on some position may differ at SIMILAR; shorter lines recur by equality.
WORDS, VARIABLE = 2, 5
#: Share of equal positions that makes one template of two lines.
SIMILAR = 0.8
#: Lines of a leaf that the first round folds, by how much that grows each round, and up to how many; lines left after that
#: many go by blocks, MOST first lines of a block a round.
FOLD, FASTER, LAST, MOST = 8, 4, 128, 512
FIELD = "<*>"
DIGITS = "0123456789"


def line_words(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fields(line: Column, w: Column) -> Column:
    """The words, each with a digit as a field."""
    masked = F.transform(w, lambda x: F.when(F.translate(x, DIGITS, "") != x, FIELD).otherwise(x))
    return F.when(F.translate(line, DIGITS, "") == line, w).otherwise(masked)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (which document), doc_id, pos, leaf, m (the masked line), t (hashes of its words) of lines that may recur.

    Words have 32 bits: a line is lost by that only if it is one position short of agreeing with a first line, and two words
    at an uneven position collide, which is to be expected for some ten of 10^12 lines."""
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    lines = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    words = lines.select("row", "doc_id", "pos", "line", line_words(F.col("line")).alias("w")).filter(F.size("w") >= WORDS)
    shown = words.select("row", "doc_id", "pos", fields(F.col("line"), F.col("w")).alias("w"))
    return shown.select("row", "doc_id", "pos", F.xxhash64(F.size("w"), F.slice("w", 1, DEPTH)).alias("leaf"), F.xxhash64("w").alias("m"), F.when(F.size("w") >= VARIABLE, F.transform("w", lambda x: F.hash(x))).alias("t"))


def agree(x: Column, y: Column) -> Column:
    """Whether two lines of as many words agree in enough positions for one template."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) >= SIMILAR * F.size(x)


def blocks(leaf: Column, t: Column) -> Column:
    """Hashes of parts of a line such that two lines of a leaf that agree have one in common. One position in five may
    differ: where that is one, the line without each of its positions after the leading words; else one stretch more than
    may differ, of all that follow those words."""
    n = F.size(t)
    free, most = n - DEPTH, F.floor(n / 5).cast("int")
    but_one = F.transform(F.sequence(F.lit(DEPTH), n - 1), lambda i: F.xxhash64(leaf, i, F.slice(t, F.lit(1), i), F.slice(t, i + 2, n - i - 1)))
    edge = lambda k: DEPTH + F.floor(k * free / (most + 1)).cast("int")
    stretch = F.transform(F.sequence(F.lit(0), most), lambda k: F.xxhash64(leaf, k, F.slice(t, edge(k) + 1, edge(k + 1) - edge(k))))
    return F.when(most <= 1, but_one).otherwise(stretch)


def first_agreeing(lines: Column) -> Column:
    """at and m of the first of sorted lines that stands before this one and agrees with it."""
    found = F.get(F.filter(lines, lambda x: (F.struct(x["at"], x["m"]) < F.struct("at", "m")) & agree(x["t"], F.col("t"))), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["at"].alias("at"), found["m"].alias("m")))


def by_blocks(rest: DataFrame, into: list[str]) -> DataFrame:
    """leaf, m, g as `merged`, for lines rest(leaf, m, at, t), which may all be of one leaf.

    A line that no line before it agrees with is a first line. One that agrees with a first line is none, and belongs to it
    once no undecided line that stands before that agrees with it too. Each round sees the `most` first undecided lines of a
    block, decides what it can from these, and holds the others against the new first lines."""
    spark, most, found, here = rest.sparkSession, FOLD, None, F.struct("at", "m")
    last: list[str] = []
    undecided = rest.withColumn("h", F.lit(None).cast("struct<at:bigint,m:bigint>"))
    while not undecided.isEmpty():
        now: list[str] = []
        every = undecided.select("leaf", "m", "at", "t", "h", F.explode(blocks(F.col("leaf"), F.col("t"))).alias("block"))
        shared = every.groupBy("block").agg(F.count("*").alias("k")).filter("k > 1").select("block")
        every = written(every.join(shared, "block", "left_semi"), "blocks", now)
        turn = F.row_number().over(Window.partitionBy("block").orderBy("at", "m"))
        seen = every.filter("h is null").withColumn("turn", turn).filter(F.col("turn") <= most + 1).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "m", "t"))).alias("f"))
        end = F.element_at("f", -1)
        looked = every.join(seen, "block").select("leaf", "m", first_agreeing(F.col("f")).alias("e"), F.when(F.size("f") > most, F.struct(end["at"].alias("at"), end["m"].alias("m"))).alias("until"))
        told = looked.groupBy("leaf", "m").agg(F.min("e").alias("e"), F.min("until").alias("until"))
        known = lambda x: F.col("until").isNull() | (x <= F.col("until"))  # noqa: E731 - all undecided lines before x were seen
        state = undecided.join(told, ["leaf", "m"], "left").withColumn("first", F.col("h").isNull() & F.col("e").isNull() & known(here))
        state = written(state, "state", now)
        heads = state.filter("first").select("leaf", F.col("m").alias("g"))
        open_ = state.filter("not first").withColumn("g", F.col("e.m")).join(heads.withColumn("is_head", F.lit(True)), ["leaf", "g"], "left").drop("g")
        near, before = F.col("h").isNull() | (F.col("e") < F.col("h")), F.col("e").isNull() | (F.col("h") < F.col("e"))
        g = F.when(F.col("is_head") & near & known(F.col("e")), F.col("e.m")).when(F.col("h").isNotNull() & before & known(F.col("h")), F.col("h.m"))
        open_ = written(open_.withColumn("g", g).select("leaf", "m", "at", "t", "h", "g"), "open", now)
        part = written(open_.filter("g is not null").select("leaf", "m", "g"), "part", into)
        found = part if found is None else found.unionByName(part)
        left = open_.filter("g is null").drop("g")
        fresh = every.join(heads, (every["leaf"] == heads["leaf"]) & (F.col("m") == F.col("g")), "left_semi").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "m", "t"))).alias("f"))
        against = every.join(left.select("leaf", "m"), ["leaf", "m"], "left_semi").join(fresh, "block").select("leaf", "m", first_agreeing(F.col("f")).alias("e")).groupBy("leaf", "m").agg(F.min("e").alias("e"))
        next_ = left.join(against, ["leaf", "m"], "left").select("leaf", "m", "at", "t", F.least("h", "e").alias("h"))
        forget_all(spark, last)
        undecided = written(next_, "undecided", last)
        forget_all(spark, now)
        most = min(MOST, most * FASTER)
    forget_all(spark, last)
    return rest.select("leaf", "m", F.lit(None).cast("long").alias("g")).limit(0) if found is None else found


def merged(keys: DataFrame, into: list[str]) -> DataFrame:
    """leaf, m, g: masked lines whose template is that of another line, g."""
    shared = keys.filter("t is not null").groupBy("leaf").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min("doc_id").alias("c"), F.max("doc_id").alias("d")).filter("a <> b and c <> d").select("leaf")
    lines = keys.filter("t is not null").join(shared, "leaf", "left_semi")
    last: list[str] = []
    rest, most = written(lines.groupBy("leaf", "m").agg(F.min("doc_id").alias("at"), F.first("t").alias("t")), "lines", last), FOLD
    found = rest.select("leaf", "m", F.lit(None).cast("long").alias("g")).limit(0)
    while most <= LAST and not rest.isEmpty():
        # as a table the heads are a small side or a side of their own, so that a hot leaf is split in the join
        now: list[str] = []
        turn = F.row_number().over(Window.partitionBy("leaf").orderBy("at", "m"))
        first = rest.withColumn("turn", turn).filter(F.col("turn") <= most).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("turn", "m", "t"))).alias("f"))
        heads = F.aggregate("f", F.slice("f", 1, 0), lambda heads, x: F.when(F.exists(heads, lambda h: agree(h["t"], x["t"])), heads).otherwise(F.concat(heads, F.array(x))))
        near = rest.join(written(first.select("leaf", heads.alias("f")), "heads", now), "leaf")
        near = near.select("leaf", "m", "at", "t", F.get(F.filter("f", lambda h: agree(h["t"], F.col("t"))), F.lit(0))["m"].alias("g"))
        near = written(near, "near", now)
        forget_all(keys.sparkSession, last)
        last = now
        found = found.unionByName(written(near.filter("m <> g").select("leaf", "m", "g"), "part", into))
        rest, most = near.filter("g is null").select("leaf", "m", "at", "t"), most * FASTER
    found = found.unionByName(by_blocks(rest, into))
    forget_all(keys.sparkSession, last)
    return found


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (a null one as the smallest number), row and drops: the places of the lines that a document loses, for
    documents that lose any, written. A template is named by its leaf and its first line's hash, a document by its doc_id
    and a hash."""
    lines: list[str] = []
    mine: list[str] = []
    keys = written(keyed(docs, id_col, text_col), "lines", lines)
    templates = keys.select("row", "doc_id", "pos", "leaf", "m").join(merged(keys, lines), ["leaf", "m"], "left").select("row", "doc_id", "pos", "leaf", F.coalesce("g", "m").alias("g"))
    templates = written(templates, "templates", mine)
    forget_all(docs.sparkSession, lines)
    common = templates.groupBy("leaf", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("leaf", "g", "first")
    common = written(common, "common", mine)
    drops = templates.join(common, ["leaf", "g"]).filter(F.col("doc_id") > F.col("first")).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))
    drops = written(drops, "drops")
    forget_all(docs.sparkSession, mine)
    return drops


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str | None = None, dropped_col: str | None = None) -> DataFrame:
    """docs with recurring lines taken out of the text; where asked for, under the given names, how many it had and lost.

    Null texts stay null and empty ones empty, with 0 and 1 lines. Rows that repeat count as one document and lose the
    same lines; rows of one doc_id don't make a line recur. A document may lose all its lines, and stays with an empty
    text. A null doc_id is the smallest. An empty table gives no rows; all other columns stay, whatever their names."""
    row, at, gone, split = "__line_dedup_row", "__line_dedup_id", "__line_dedup_drops", "__line_dedup_lines"
    drops = recurring(docs, id_col, text_col).select(F.col("row").alias(row), F.col("doc_id").alias(at), F.col("drops").alias(gone))
    text = F.col(text_col)
    marked = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), text)).withColumn(at, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).join(drops, [at, row], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col(split), i)), "\n")
    out = marked.withColumn(split, F.split(text, "\n", -1))
    if lines_col:
        out = out.withColumn(lines_col, F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long"))
    if dropped_col:
        out = out.withColumn(dropped_col, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(kept)).drop(row, at, gone, split)
