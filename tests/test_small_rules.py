"""Pipe tables, exemplars, sessions, counters, corrections and citations against plain Python."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import pii
from foliospark.operators import access, classify, contexts, dynamic, records, usage, validate
from foliospark.sources import markup


def tables(text):
    """By the lines, one after the other."""
    lines, out, i = text.split("\n"), [], 0
    split = lambda x: [c.strip() for c in x.split("|") if c.strip()]
    while i < len(lines):
        if "|" in lines[i] and i + 1 < len(lines) and "---" in lines[i + 1]:
            j = i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
            headers, rows = split(lines[i]), [r for r in map(split, lines[i + 2 : j]) if r]
            if headers and rows:
                out.append((headers, rows, "\n".join(lines[i:j])))
            i = j
        else:
            i += 1
    return out


def test_pipe_tables_equal_a_loop(spark):
    rng = random.Random(7)
    some = ["| a | b |", "|---|---|", "---", "x", "", "||", "1|2", " | é | ", "|--|", "a --- | b", "| - | --- |", "\t| q |"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["", "|", "a|b\n---", "a|b\n---\nc|d\r\ne|f\r\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(t.headers, t.rows, t.raw_text) for t in r.x] for r in rows.select("i", markup.pipe_tables(F.col("t")).alias("x")).collect()}
    assert got == {i: tables(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(markup.pipe_tables(F.col("t")).alias("x")).first().x is None


def test_long_pipe_tables(spark):
    text = "h|i\n---\n" + "\n".join(f"{i}|x" for i in range(30_000)) + "\n" + "|" * 200_000 + "\n" + "z" * 100_000
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(markup.pipe_tables(F.col("t")), lambda t: F.size(t["rows"])).alias("n")).first()
    assert got.n == [30_000]


def plain_stage(text, vector, exemplars):
    if not text or not text.strip():
        return "general", 0.0
    head = text[: classify.HEAD].lower()
    k = {t: round(sum(s in head for s in x) / len(x), 9) for t, x in classify.SIGNALS.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    e = {t: round(sum(a * b for a, b in zip(vector, v)) / (size(vector) * size(v)), 9) if vector and size(vector) * size(v) else 0.0 for t, v in exemplars.items()}
    both = sorted(((0.5 * k.get(t, 0) + 0.5 * e.get(t, 0), t) for t in {*k, *e}), key=lambda x: (-x[0], x[1]))
    lead = round(min((both[0][0] - both[1][0]) / classify.SPREAD, 1.0), 3) if both[0][0] > 0 else 0.0
    return (both[0][1] if lead else "general"), lead


def test_exemplars_and_phrases_by_halves(spark):
    exemplars = {"invoice": [1.0, 0.0], "memo": [0.0, 1.0], "report": [-1.0, 0.5], "zero": [0.0, 0.0]}
    texts = ["Invoice No 1, bill to", "nothing", "", " \n", None, "PLAINTIFF whereas", "x" * 500 + "invoice no"]
    vectors = [[0.9, 0.1], [0.0, 3.0], [0.0, 0.0], None, [-1.0, -1.0]]
    rows = [(i, t, v) for i, (t, v) in enumerate((t, v) for t in texts for v in vectors)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id int, text string, embedding array<double>")
    ex = spark.createDataFrame([*exemplars.items(), (None, [1.0, 1.0])], "doc_type string, embedding array<double>")
    done = classify.stage1(docs, ex)
    got = sorted((r.doc_id, r.doc_type, r.confidence) for r in done.collect())
    assert got == sorted((i, *plain_stage(t, v, exemplars)) for i, t, v in rows + rows[:1])
    assert "Exchange hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()
    none = classify.stage1(docs, ex.limit(0)).filter("doc_id = 0").first()
    assert (none.doc_type, none.confidence) == plain_stage(texts[0], None, {})
    assert classify.stage1(docs.limit(0), ex).count() == 0
    with pytest.raises(ValueError, match="exemplars"):
        classify.stage1(docs, spark.range(classify.EXEMPLARS + 1).select(F.col("id").cast("string").alias("doc_type"), F.array(F.lit(1.0)).alias("embedding")))


def test_vision_needs_a_provider(spark):
    rows = [("a.PNG", "w " * 60, False, "invoice", "p", True), ("a.png", None, True, "id_document", None, False), ("a.png", "", True, None, "", False), ("a.pdf", "w " * 60, None, None, "p", False), ("a.pdf", "w " * 49, None, None, "p", True), ("a.pdf", None, None, None, "p", True), (None, "w " * 60, True, None, "p", True), ("a.txt", "w " * 60, False, "id_document", "p", True)]
    d = spark.createDataFrame(rows, "path string, text string, s boolean, k string, p string, want boolean")
    got = d.select(classify.needs_vision(F.col("path"), F.col("text"), F.col("s"), F.col("k"), F.col("p")).alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_sessions(spark):
    rows = [(1, "a", 7, 4, 0.0005), (1, "a", 3, 0, 0.0015), (1, None, None, 9, None), (1, "b", 8, 8, 2.0), (None, "a", 4, 4, 1.0)]
    d = spark.createDataFrame(rows, "u int, call_type string, prompt_chars long, response_chars long, latency double")
    got = {(r.u, r.call_type, r.is_total): (r.calls, r.tokens, r.avg_latency_ms) for r in usage.session(d, "u").collect()}
    assert got == {(1, "a", False): (2, 2, 1), (1, None, False): (1, 2, None), (1, "b", False): (1, 4, 2000), (1, None, True): (4, 8, 667), (None, "a", False): (1, 2, 1000), (None, None, True): (1, 2, 1000)}
    assert usage.session(d.limit(0), "u").count() == 0


def test_counters(spark):
    at = lambda *x: datetime.datetime(2024, *x)
    docs = spark.createDataFrame([(1,), (1,), (2,), (None,)], "user_id int")
    lineage = spark.createDataFrame([(1, "upload_received", at(3, 5)), (1, "upload_received", at(3, 4, 23, 59, 59)), (1, "parsed", at(3, 5)), (3, "upload_received", at(3, 6)), (3, "upload_received", None)], "user_id int, event_type string, ts timestamp")
    calls = spark.createDataFrame([(1, "query", 0.5, at(3, 5, 1)), (1, "query", 0.25, at(3, 1)), (1, "query", 9.0, at(2, 29, 23)), (2, "extract", None, at(3, 9)), (2, "query", 1.0, None)], "user_id int, call_type string, cost double, ts timestamp")
    day = F.lit("2024-03-05").cast("date")
    got = {r.user_id: tuple(r)[1:] for r in usage.counters(docs, lineage, calls, day).collect()}
    assert got == {1: (2, 1, 0.75, 1), 2: (1, 0, 0.0, 0), 3: (0, 1, 0.0, 0), None: (1, 0, 0.0, 0)}
    assert usage.counters(docs.limit(0), lineage.limit(0), calls.limit(0), day).count() == 0


def test_corrections_are_capped(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("AB"), f"f{rng.randrange(8)}", rng.choice(["x", "y", "", None]), rng.choice(["x", "z", None]), rng.choice(["correct", "accept"]), rng.choice([1, 2, 3, None])) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, doc_type string, field string, original string, corrected string, action string, created_at int")
    fields = ["f5", "f1", "f0", "f7", "f2", "f3", "f4"]
    want = []
    for kind in "AB":
        shown = []
        for f in fields[:5]:
            own = sorted((r for r in rows if r[1] == kind and r[2] == f and r[5] == "correct"), key=lambda r: (r[6] is None, -(r[6] or 0), r[0]))
            shown += [(f, r[3], r[4]) for r in own[:3] if r[3] and r[4] and r[3] != r[4]]
        want += [(kind, i, *s) for i, s in enumerate(shown[:5], 1)]
    assert sorted(tuple(r) for r in contexts.correction_examples(d, fields).collect()) == sorted(want) and want
    assert contexts.correction_examples(d.limit(0), fields).count() == 0


def test_citations_run_by_request(spark):
    rows = [("q", 1, 2, "s"), ("q", 1, 1, "s"), ("q", 2, 1, ""), ("q", 3, 1, None), ("q", 2, 2, "s"), ("r", 1, 1, "s")]
    got = records.cited(spark.createDataFrame(rows, "request string, rank int, criterion_pos int, snippet string"), "request").collect()
    assert sorted((r.request, r.rank, r.criterion_pos, r.number) for r in got) == [("q", 1, 1, 1), ("q", 1, 2, 2), ("q", 2, 2, 3), ("r", 1, 1, 1)]


def test_totals_of_visible_documents_equal_their_pairs(spark):
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice([*x, None])
    docs = [(rnd.randrange(60), pick(*range(8)), pick(1, 2, 3, 4), pick(10, 20, 30), pick("private", "team", "team", "org")) for _ in range(90)] + [(None, 1, 1, 10, "team")]
    users = [(pick(*range(4, 12)), pick(1, 2, 3, 4), pick(10, 20, 30), pick("org_admin", "member"), pick(True, False), pick(True, False)) for _ in range(20)]
    documents = spark.createDataFrame(docs, "doc_id long, owner long, team_id long, org_id long, visibility string")
    members = spark.createDataFrame(users, "user_id long, team_id long, org_id long, role string, reads_teams boolean, active boolean")
    want = access.visible(documents, members).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum"))
    got = access.visible_totals(documents, members)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 3  # users and owners by their key; kinds meet places, not documents


def test_personal_data_is_cut_out_once_for_each_kind(spark):
    """Each pattern but the last replaces once; what it left is not worked out anew for those after it."""
    plan = spark.range(1).select(pii.matches(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == len(pii.PATTERNS) - 1


def analyzed(spark, column):
    return spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_rules_work_out_their_values_once(spark):
    s, n = F.col("id").cast("string"), len(validate.money.RULE_MARKS)
    assert analyzed(spark, validate.positive_rule(s, "f")).count("replace(") == n
    assert analyzed(spark, validate.sum_rule(F.array(s), s, "f")).count("replace(") == 2 * n
    plan = analyzed(spark, validate.order_rule(s, s, "f"))
    assert plan.count("initcap(") == 2 and plan.count("try_to_timestamp(") == 2 * len(validate.dates.RULE_FORMATS)


def test_scores_work_out_their_values_once(spark):
    s = F.col("id").cast("string")
    assert analyzed(spark, validate.confidence(s, "date")).count("initcap(") == 1
    assert analyzed(spark, validate.confidence(s, "text")).count("split(") == 1


def test_found_fields_without_scores(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"full_name": "A B", "email": "a@b.org", "skills": ["x"]}', '{"email": "x", "skills": [], "phone": null}', "[1", None, '{"skills": "x", "email": "a@b.org"}'])], "i int, t string")
    df = rows.select("i", dynamic.parsed(F.col("t"), dynamic.template("cv_resume")).alias("r"))
    both = df.select(validate.overall(dynamic.scores(df, "r"))[2], dynamic.found_count(F.col("r"), df.schema["r"].dataType).alias("n")).collect()
    assert [r.n for r in both] == [r.found_count for r in both] and max(r.n for r in both) == 3
