"""White space, references to characters and names of files, against the standard library."""

import html
import random
import time

from pyspark.sql import functions as F

from foliospark.functions import entities, strings

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def results(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    return [r[1:] for r in sorted(tuple(r) for r in rows.select("i", *columns).collect())]


def test_references_as_the_library_reads_them(spark):
    rng = random.Random(5)
    some = ["&amp;", "&amp", "&ampx", "&notit;", "&notin;", "&unknown;", "&", "&;", "&#", "&#;", "&#x;", "&#65", "&#65;", "&#x41;", "&#X00041", "&#0;", "&#128;", "&#129;", "&#13;", "&#1;", "&#11;", "&#127;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xfffe;", "&#x1ffff;", "&#64976;", "&#x000000000000000041;", "&lt;b&gt;", "&copy 2", "&alpha", "&alpha;", "&CounterClockwiseContourIntegral;", "&" + "a" * 40 + ";", "&acE;", "&fjlig;", "plain", "é", "\U0001f600", " ", ";", "&&amp;amp;", "&#xFDD0", "&l", "&lt", "&gtx;"]
    texts = some + ["".join(rng.choice(some) for _ in range(rng.randrange(1, 6))) for _ in range(600)] + ["", "&" * 50]
    assert [g for (g,) in results(spark, texts, entities.decoded(F.col("t")))] == [html.unescape(t) for t in texts]
    assert results(spark, [None], entities.decoded(F.col("t"))) == [(None,)]


def test_sanitised_answers(spark):
    texts = ["<b>a &amp; b</b>&nbsp;", "&lt;script&gt;x&lt;/script&gt;", "<script>a</script> 1 &lt 2", None, ""]
    assert results(spark, texts, strings.without_markup(F.col("t"))) == [("a & b",), ("<script>x</script>",), ("1 < 2",), (None,), ("",)]


def test_white_space_of_any_script(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(SPACES + "ab") for _ in range(rng.randrange(12))) for _ in range(400)] + [SPACES, "a", "", "​a​"]
    got = results(spark, texts, strings.stripped(F.col("t")), strings.word_count(F.col("t")))
    assert got == [(t.strip(), len(t.split())) for t in texts]


def test_inner_white_space_takes_no_time(spark):
    text = "a" + " " * 400_000 + "b "
    began = time.time()
    assert results(spark, [text], F.length(strings.stripped(F.col("t")))) == [(400_002,)]
    assert time.time() - began < 20


def test_names_of_any_script(spark):
    names = ["Überblick 2024", " a/b.c ", "名前-1", "__x__", "...", "", "½_²"]
    safe = lambda n: "".join(c if c.isalnum() or c in "-_" else "_" for c in n.strip()).strip("_") or "table"
    assert [g for (g,) in results(spark, names, strings.safe_name(F.col("t")))] == [safe(n) for n in names]


def test_texts_are_stripped_and_split_once(spark):
    for made in (strings.collapsed, strings.word_count):
        plan = spark.range(1).select(made(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") == 1 and plan.lower().count("trim(") == 1 and "regexp_replace" not in plan


def test_long_runs_of_any_white_space(spark):
    words = [f"w{i}" for i in range(61)]
    texts = [" " + " \n".join(words) + "　", " ".join(words[:60]) + " ", None]
    want = [(" ".join(words[:12]) + " ... 61 words unchanged",), (texts[1],), (None,)]
    assert results(spark, texts, strings.collapsed(F.col("t"))) == want
