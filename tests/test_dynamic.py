"""Records of declared shapes against plain Python over the same JSON texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import dynamic, reshape
from foliospark.operators import validate as v

ITEM = [{"name": "role", "type": "string"}, {"name": "start_year", "type": "string"}, {"name": "end_year", "type": "string"}, {"name": "total_time", "type": "string"}, {"name": "skills", "type": "list"}]
SPEC = [
    {"name": "email", "type": "string"},
    {"name": "total_experience", "type": "number"},
    {"name": "remote", "type": "boolean"},
    {"name": "home", "type": "object", "properties": [{"name": "city", "type": "string"}, {"name": "floor", "type": "integer"}]},
    {"name": "languages", "type": "list"},
    {"name": "past jobs", "type": "list", "properties": ITEM},
]
TOP = [f["name"].replace(" ", "_") for f in SPEC]
SUB = [f["name"] for f in ITEM]


def blank(x):
    return x in (None, "", [])


def share(record, names):
    return sum(not blank(record.get(n)) for n in names) / len(names) if record is not None else 0.0


def score(name, x):
    if x is None:
        return 0.0
    if name == "past_jobs":
        return round(sum(share(i, SUB) for i in x) / len(x), 2) if x and x[0] is not None else 0.9 if x else 0.0
    if name == "home":
        return round(share(x, ["city", "floor"]), 2)
    if isinstance(x, list):
        return 0.9 if x else 0.0
    if isinstance(x, (bool, int, float)):
        return 0.95
    return 0.0 if not x.strip() or x.lower() == "n/a" else 0.95 if "@" in x else 0.4


def computed(job):
    """Starts are 2019-01-01, ends 2021-01-01; without an end the day of the check counts."""
    return ("2y" if job.get("end_year") else "5y") if job and job.get("start_year") else None


def rules(record):
    jobs = record.get("past_jobs") or []
    out = {(f, "GENERIC_002") for f in TOP if blank(record.get(f))}
    if jobs and jobs[0] is not None:
        for i, job in enumerate(jobs):
            gone = [n for n in SUB if job is not None and blank(job.get(n)) and not (n == "total_time" and computed(job))]
            out |= {(f"past_jobs[{i}]", "GENERIC_001", "missing: " + ", ".join(gone))} if gone else set()
    for i, job in enumerate(jobs):
        stated = (job or {}).get("total_time")
        if computed(job) and stated and stated.lower() != computed(job):
            out.add((f"past_jobs[{i}]", "GENERIC_003", f"stated {stated}, computed {computed(job)}"))
    return out


def drawn(rng):
    def job():
        whole = {"role": rng.choice(["dev", "", None]), "start_year": rng.choice(["2019-01-01", ""]), "end_year": rng.choice(["2021-01-01", None]), "total_time": rng.choice(["2Y", "7y", "", None]), "skills": rng.choice([["a"], [], None])}
        return rng.choice([None, whole, whole, {k: x for k, x in whole.items() if x is not None}])

    full = {
        "email": rng.choice(["a@b.org", "no", "", None, "N/A"]), "total_experience": rng.choice([0, 2.5, None]), "remote": rng.choice([True, False, None]), "home": rng.choice([None, {}, {"city": "Graz"}, {"city": "", "floor": 0}]),
        "languages": rng.choice([None, [], ["de", "en"]]), "past_jobs": rng.choice([None, [], [job() for _ in range(rng.randint(1, 5))]]),
    }
    return {k: x for k, x in full.items() if x is not None or rng.random() < 0.5} | {"undeclared": 1}


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", dynamic.parsed(F.col("t"), SPEC).alias("record"))
    return dynamic.verified(df, "record", F.lit("2024-01-01").cast("date"))


def test_records_equal_plain_python(spark):
    rng = random.Random(5)
    made = [drawn(rng) for _ in range(150)]
    df = read(spark, map(json.dumps, made))
    rows = df.select("n", dynamic.scores(df, "record").alias("s"), dynamic.findings(df, "record").alias("f")).collect()
    for r in rows:
        record = made[r.n]
        jobs = [j | {"total_time": computed(j)} if computed(j) and not j.get("total_time") else j for j in record.get("past_jobs") or []]
        filled = record | ({"past_jobs": jobs} if record.get("past_jobs") is not None else {})
        assert {s.field: s.confidence for s in r.s} == pytest.approx({n: score(n, filled.get(n)) for n in TOP}), record
        got = {(f.field, f.rule_code) if f.rule_code == "GENERIC_002" else (f.field, f.rule_code, f.detail) for f in r.f}
        assert got == rules(record) and len(got) == len(r.f), record


def test_odd_records(spark):
    """No object, an empty text, null, an empty object, an empty table."""
    df = read(spark, ["[1]", "", None, "{}", "no json"])
    out = {r.n: (r.s, r.f) for r in df.select("n", dynamic.scores(df, "record").alias("s"), dynamic.findings(df, "record").alias("f")).collect()}
    assert all(e.status == "NOT_FOUND" and e.confidence == 0 for s, _ in out.values() for e in s)
    assert [len(f) for _, f in (out[2], out[3])] == [0, len(TOP)]
    assert dynamic.verified(df.filter("n > 9"), "record", F.current_date()).select(dynamic.findings(df, "record")).count() == 0
    with pytest.raises(TypeError, match="no record"):
        dynamic.scores(df, "n")


def test_values_without_places(spark):
    field = lambda t: f"struct<value:{t},bbox:array<double>>"
    inner = f"struct<name:{field('string')},cells:array<{field('bigint')}>>"
    shape = f"struct<a:{field('string')},b:array<{inner}>,c:{field(f'array<{inner}>')},d:double>"
    text = '{"a":{"value":"x","bbox":[1]},"b":[{"name":{"value":"n"},"cells":[{"value":1},null]},null],"c":{"value":[{"name":null,"cells":[]}]},"d":2.5}'
    df = spark.createDataFrame([(text,), (None,)], "t string").select(F.from_json("t", shape).alias("r"))
    got = df.select(F.to_json(dynamic.unwrapped(F.col("r"), df.schema["r"].dataType), {"ignoreNullFields": "false"}).alias("j")).collect()
    assert json.loads(got[0].j) == {"a": "x", "b": [{"name": "n", "cells": [1, None]}, None], "c": [{"name": None, "cells": []}], "d": 2.5}
    assert got[1].j is None


def test_shapes():
    assert dynamic.outline(reshape.schema(SPEC))[3:8] == ["- home (object)", "  - city (string)", "  - floor (bigint)", "- languages (list)", "- past_jobs (list)"]
    assert dynamic.pairs(reshape.schema(SPEC)) == {"past_jobs": {"start": "start_year", "end": "end_year", "duration": "total_time"}}
    assert {t: len(dynamic.template(t)) for t in dynamic.TEMPLATES}["cv_resume"] == 12 and len(dynamic.TEMPLATES) == 9
    assert [v.named_type(n) for n in ("work_email", "candidate_name", "total_time", "linkedin", "", "skills")] == ["email", "text", "amount", "url", "text", "list"]


def test_scores_read_a_date_once(spark):
    df = spark.createDataFrame([("2024-01-02",)], "d string").select(F.struct(F.col("d").alias("issue_date")).alias("r"))
    plan = df.select(dynamic.scores(df, "r").alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("initcap(") == 1


def test_a_record_is_read_once_for_its_scores_and_findings(spark, sf_dir):
    """No filter asks beforehand whether the list is empty, and the list is a column before it is exploded."""
    from foliospark.plans import dynamic as plans

    for query in (plans.dynamic_scores, plans.dynamic_rules):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        generate = next(line for line in plan.splitlines() if "Generate " in line)
        assert "lambda" not in generate and plan.count("from_json(") == 1, plan
        assert not any("Filter" in line and "aggregate(" in line for line in plan.splitlines()), plan


def test_iso_dates_equal_their_format(spark):
    """A cast reads what the format reads, and nothing else."""
    from foliospark.functions import dates

    texts = ["2024-01-02", " 2024-1-2 ", "2024-02-30", "2024-13-01", "2024-00-10", "0000-01-01", "0001-01-01", "9999-12-31", "2024-01-02\n", "\t2024-01-02", "2024-01-2x", "٢٠٢٤-٠١-٠٢", "+2024-01-02", "2024-1", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", dates.parsed(F.col("t"), dates.CHECK_FORMATS).cast("string").alias("new"), dates.any_of(F.col("t"), dates.CHECK_FORMATS).cast("string").alias("old")).collect()
    assert [(r.t, r.new) for r in rows] == [(r.t, r.old) for r in rows]
    assert [r.t for r in rows if r.new] == ["2024-01-02", " 2024-1-2 ", "0000-01-01", "0001-01-01", "9999-12-31"]
    assert "gettimestamp" not in df.select(dates.iso(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_text_score_as_before(spark):
    texts = ["", "a", "ab", "abc", "a b", " a  b ", "\tab\t", "\t\t\t", "a\nb", "a\x0bb", "ab cd", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", v.confidence(F.col("t"), "text").alias("s")).collect()}
    for t in texts:
        x = t.strip(" ")
        n = len([w for w in x.replace(" ", "_").split() if w])
        assert got[t] == (0.0 if x == "" else 0.85 if n >= 2 else 0.7 if n == 1 and len(x) > 2 else 0.5), repr(t)
