"""Candidate pools, places of values, duplicates, versions, expiring entries and tables kept by streams, against plain code."""

import itertools
import os
import random

import numpy as np
import pytest

from foliospark.operators import adapters, classify, duplicates, extraction, fusion, places, retrieval, usage, versions
from foliospark.streaming import usage as stream

# --- pools


def corpus(spark, seed, n=120, q=4, words="abcdef"):
    """Few distinct vectors and words, so that ties are everywhere."""
    rng = np.random.default_rng(seed)
    pool = rng.choice([-1.0, 0.0, 1.0, 2.0], (9, 3))
    chunks = [(int(i * 7 % n), int(i % 5), " ".join(rng.choice(list(words), rng.integers(0, 6))), pool[rng.integers(9)].tolist()) for i in range(n)]
    asked = [(i * 10, [str(w) for w in rng.choice(list(words + "z"), rng.integers(0, 3))], pool[rng.integers(9)].tolist()) for i in range(q)]
    return spark.createDataFrame(chunks, "chunk_id long, doc_id long, content string, vector array<double>"), spark.createDataFrame(asked, "qid long, terms array<string>, qvector array<double>")


def listed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("seed, pool", [(1, 1), (2, 5), (3, 40), (4, 500)])
def test_pool_equals_full_ranks(spark, seed, pool):
    chunks, asked = corpus(spark, seed)
    columns = ("qid", "chunk_num", "chunk_id", "rrf")
    assert listed(fusion.searched(chunks, asked, pool), *columns) == listed(retrieval.hybrid(chunks, asked, pool), *columns)


def test_term_scores_equal_the_join(spark, monkeypatch):
    monkeypatch.setattr(fusion, "SCORED", 7)
    monkeypatch.setattr(fusion, "HELD", 2)
    chunks, asked = corpus(spark, 8, n=200, q=5)
    done = fusion.term_scores(chunks.drop("vector"), asked)
    columns = ("qid", "chunk_id", "sparse")
    assert listed(done, *columns) == listed(retrieval.bm25(chunks, asked), *columns) != []
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert fusion.term_scores(chunks, asked.filter("qid < 0")).collect() == []


def test_term_scores_have_equal_scores_together(spark, monkeypatch):
    """Each chunk's rows come together and by score, so that a file's writer finds equal scores side by side."""
    monkeypatch.setattr(fusion, "SCORED", 90)
    chunks, asked = corpus(spark, 9, n=60, q=30, words="abc")
    rows = [(r["qid"], r["chunk_id"], r["sparse"]) for r in fusion.term_scores(chunks.drop("vector"), asked).collect()]
    runs = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[1])]
    assert len(runs) == len({r[1] for r in rows}) > 30
    assert all(run == sorted(run, key=lambda r: (r[2], r[0])) for run in runs)
    assert any(run != sorted(run) for run in runs)


def test_pool_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CELLS", 2 * fusion.depth(2) + 1)
    monkeypatch.setattr(fusion, "SCORED", 7)
    chunks, asked = corpus(spark, 5, n=400)
    assert len(list(fusion.blocks(asked, fusion.depth(2)))) == 4
    assert listed(fusion.searched(chunks, asked, 2), "qid", "chunk_num", "chunk_id") == listed(retrieval.hybrid(chunks, asked, 2), "qid", "chunk_num", "chunk_id")


def test_pool_of_some_documents_and_top(spark):
    chunks, asked = corpus(spark, 6)
    open_ = spark.createDataFrame([(1,), (3,), (3,), (99,)], "doc_id long")
    want = retrieval.hybrid(chunks.filter("doc_id in (1, 3)"), asked, 6)
    assert listed(fusion.searched(chunks, asked, 6, document_ids=open_), "qid", "chunk_num", "chunk_id") == listed(want, "qid", "chunk_num", "chunk_id")
    assert listed(fusion.searched(chunks, asked, 6, top=2), "qid", "chunk_id") == listed(retrieval.hybrid(chunks, asked, 2), "qid", "chunk_id")
    assert fusion.searched(chunks, asked, 3, top=9).count() == 12
    assert fusion.searched(chunks.limit(0), asked).count() == 0 == fusion.searched(chunks, asked.limit(0)).count()


def test_depth_holds_every_chunk_of_a_pool():
    for pool in (1, 5, 500, 20_000):
        k = fusion.depth(pool)
        assert 1 / (fusion.RRF + pool) > 2 / (fusion.RRF + 1 + k) + 1e-9 * (pool < 5000)


def test_counts_of_what_stands_before():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 9, 2)
        own, own_ids = rng.integers(0, 3, n).astype(float), rng.permutation(20)[:n]
        cand, ids = rng.integers(0, 3, m).astype(float), rng.permutation(20)[:m]
        want = [sum((s, -i) > (c, -k) for s, i in zip(own, own_ids)) for c, k in zip(cand, ids)]
        assert fusion.before(cand, ids, own, own_ids).tolist() == want


def test_no_table_of_all_pairs(spark, monkeypatch):
    """What a search writes has the size of the chunks or of the candidates, not of queries times chunks."""
    rows, put = [], fusion.written
    monkeypatch.setattr(fusion, "written", lambda df, name: (t := put(df, name), rows.append(t.count()))[0])
    chunks, asked = corpus(spark, 7, n=600)
    got = listed(fusion.searched(chunks, asked, top=1), "qid", "chunk_id", "rrf")
    assert got == listed(retrieval.hybrid(chunks, asked, 1), "qid", "chunk_id", "rrf")
    assert max(rows) <= 600


def test_pool_of_queries_without_known_terms(spark):
    chunks, asked = corpus(spark, 8)
    asked = asked.selectExpr("qid", "array('zz') AS terms", "qvector")
    assert listed(fusion.searched(chunks, asked, 5), "qid", "chunk_num", "chunk_id") == listed(retrieval.hybrid(chunks, asked, 5), "qid", "chunk_num", "chunk_id")


@pytest.mark.parametrize("size", [3, 1 << 61])
def test_counts_for_all_queries_of_a_block(size):
    rng = np.random.default_rng(4)
    score, ids = rng.integers(0, 3, (5, 8)) * float(size), np.sort(rng.permutation(30)[:8])
    held, chunk, at = rng.integers(0, 3, 20) * float(size), rng.integers(0, 30, 20), np.array([0, 3, 3, 9, 14, 20])
    got = fusion.standing(score, ids, held, chunk, at, np.searchsorted(ids, chunk))
    want = [sum((s, -i) > (held[j], -chunk[j]) for s, i in zip(score[q], ids)) for q in range(5) for j in range(at[q], at[q + 1])]
    assert got.tolist() == want


def test_neighbours_equal_all_pairs(spark, monkeypatch):
    chunks, asked = corpus(spark, 9, n=90, q=6)
    score = retrieval.F.round(retrieval.cosine(retrieval.F.col("qvector"), retrieval.F.col("vector")), 6)
    every = chunks.join(asked, chunks["chunk_id"] != asked["qid"]).select("qid", "chunk_id", score.alias("score")).collect()
    want = {}
    for q, c, s in sorted(every, key=lambda r: (r[0], -r[2], r[1])):
        want.setdefault(q, []).append((q, c, s, len(want.get(q, [])) + 1))
    for asked_, scored in ((512, 1 << 20), (2, 7)):
        monkeypatch.setattr(fusion, "ASKED", asked_)
        monkeypatch.setattr(fusion, "SCORED", scored)
        got = fusion.neighbours(chunks, asked, 10, 6)
        assert listed(got, "qid", "chunk_id", "score", "place") == sorted(r for rows in want.values() for r in rows[:10])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert fusion.neighbours(chunks, asked.limit(0), 10, 6).count() == 0 == fusion.neighbours(chunks.limit(0), asked, 10, 6).count()


# --- places


def test_places_equal_search(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [(i // 4, i, "".join(rnd.choice("abÄ ß") for _ in range(rnd.randint(0, 60))), None if i % 5 == 0 else f"b{i}") for i in range(80)]
    values = [(i, "".join(rnd.choice("abÄ ß") for _ in range(rnd.randint(0, 6)))) for i in range(150)] + [(200, None), (201, "  abab "), (202, "ABAB")]
    want = {}
    for (k, v), (doc, chunk, text, box) in itertools.product(values, sorted(texts, key=lambda t: t[1])):
        v = (v or "").strip().lower()
        at = text.lower().find(v)
        if len(v) >= 4 and box is not None and at >= 0 and ((k, doc) not in want or at < want[k, doc][1]):
            want[k, doc] = (chunk, at, box)
    chunks = spark.createDataFrame(texts + [(99, 999, None, "b")], "doc_id long, chunk_id long, content string, bbox string")
    found = spark.createDataFrame(values, "value_id long, value string")
    for most in (places.CHARACTERS, 25):
        got = {(r["value_id"], r["doc_id"]): (r["chunk_id"], r["at"], r["bbox"]) for r in places.places(chunks, found, most).collect()}
        assert got == want and want
    assert places.places(chunks, found.limit(0)).count() == 0 == places.places(chunks.limit(0), found).count()


# --- duplicates


def test_components_of_chains_hubs_and_loops(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(70, 70), (71, None)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    root = {}
    for u, v in links:
        root.setdefault(u, u)
        root.setdefault(v if v is not None else u, v if v is not None else u)
    for _ in range(100):
        for u, v in links:
            if v is not None:
                root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in duplicates.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == root


def test_duplicate_people(spark):
    people = [
        (1, "Ann Lee", "ann@x.org", "+1 (555) 010-2030", "A"),
        (2, "LEE, Ann", None, "15550102030", "B"),
        (3, "Bob Ray", " ANN@X.ORG ", None, "A"),
        (4, "Bob Ray", "bob@x.org", "123", None),
        (5, "Bob", None, None, "a "),
        (6, None, None, None, None),
    ]
    df = spark.createDataFrame(people, "id long, name string, email string, phone string, school string")
    from pyspark.sql import functions as F

    keys = {"email": duplicates.email_key(F.col("email")), "phone": duplicates.phone_key(F.col("phone"))}
    grouped = duplicates.groups(df, keys)
    assert listed(grouped, "id", "root", "size") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
    assert [(r["root"], r["size"], r["fields"]) for r in duplicates.contradictions(df, grouped, ["school", "email", "name"]).collect()] == [(1, 3, ["school", "name"])]
    by_name = duplicates.groups(df, keys | {"name": duplicates.name_key(F.col("name"))})
    assert listed(by_name, "id", "root") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)]
    assert duplicates.groups(df.limit(0), keys).count() == 0


# --- versions


def test_script_rebuilds_and_is_shortest():
    rnd = random.Random(1)
    for t in range(1500):
        a = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 14))] if t % 2 else [w for w in a if rnd.random() < 0.8]
        for most in (versions.EDITS, 2):
            runs = versions.joined(versions.script(a, b, most))
            assert [w for k, s, e in runs if k != "added" for w in a[s:e]] == a
            assert [w for k, s, e in runs if k != "removed" for w in (b if k == "added" else a)[s:e]] == b
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert sum(e - s for k, s, e in versions.shortest(a, b, 0, len(a), 0, len(b), 100) if k == "unchanged") == table[-1, -1]


def test_rising_run_is_longest():
    rnd = random.Random(2)
    for _ in range(100):
        order = rnd.sample(range(9), rnd.randint(0, 8))
        got = [b for _, b in versions.rising(list(enumerate(order)))]
        assert got == sorted(got) and len(got) == max((len(c) for r in range(9) for c in itertools.combinations(order, r) if list(c) == sorted(c)), default=0)


def test_versions_of_pages(spark):
    old = [(1, "a", 1, "The first page  has these words"), (1, "a", 2, "and the second\nhas others"), (2, "a", 1, "same on both sides"), (3, "a", 1, "only here"), (4, "a", 1, " ")]
    new = [(1, "b", 1, "The first page has new words"), (1, "b", 2, "and the second"), (1, "b", 3, "has many others"), (2, "b", 1, "same on both sides"), (5, "b", 1, "only there")]
    runs = versions.diff(spark.createDataFrame(old + new, "key long, side string, page_num int, content string"))
    rows = {r["key"]: r for r in versions.rebuilt(runs).collect()}
    join = lambda rows, k: " ".join(" ".join(t.split()) for i, _, _, t in rows if i == k)
    assert {k: (r["a"], r["b"]) for k, r in rows.items()} == {k: (join(old, k), join(new, k)) for k in (1, 2, 3, 5)}
    stats = {r["key"]: (r["additions"], r["removals"], r["unchanged"], r["pages_touched"]) for r in versions.statistics(runs).collect()}
    assert stats == {1: (2, 1, 10, [1, 3]), 2: (0, 0, 4, []), 3: (0, 2, 0, [1]), 5: (2, 0, 0, [1])}
    assert versions.diff(spark.createDataFrame([], "key long, side string, page_num int, content string")).count() == 0


def test_short_pairs_as_one_row_give_the_runs_of_long_ones(spark, monkeypatch):
    rnd = random.Random(9)
    page = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 30)))
    rows = [(k, s, p, page()) for k in range(25) for s in "ab" for p in range(1, rnd.randint(1, 4))]
    pages = spark.createDataFrame([*rows, (99, "a", 1, "  "), (98, "b", 1, "x y"), (97, "a", 1, None)], "key long, side string, page_num int, content string")
    columns = ["key", "segment", "i", "kind", "page_a", "page_b", "n_words", "words"]
    want = sorted(map(tuple, versions.by_words(pages, versions.EDITS).select(columns).collect()), key=str)
    for most in (versions.WHOLE, 150, 0):
        monkeypatch.setattr(versions, "WHOLE", most)
        assert sorted(map(tuple, versions.diff(pages).select(columns).collect()), key=str) == want
    monkeypatch.undo()
    plan = versions.diff(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1  # pages meet once


def test_versions_of_long_texts_in_segments(spark):
    rnd = random.Random(7)
    a = [rnd.choice(["x", "y", f"w{i}"]) for i in range(6000)]
    b = [w for w in a if rnd.random() < 0.97]
    for i in range(0, len(b), 50):
        b.insert(i, f"new{i}")
    rows = [(1, s, i, " ".join(t[i * 100 : i * 100 + 100])) for s, t in (("a", a), ("b", b)) for i in range(len(t) // 100 + 1)]
    runs = versions.diff(spark.createDataFrame(rows, "key long, side string, page_num int, content string"))
    found = versions.rebuilt(runs).first()
    assert (found["a"], found["b"]) == (" ".join(a), " ".join(b))
    stats = versions.statistics(runs).first()
    assert stats["removals"] <= 1.1 * (len(a) + len(b) // 50 - len(b) + len(b) // 50) and runs.agg({"segment": "max"}).first()[0] > 1000


# --- expiring entries, and tables that streams keep


def plain_entries(rows, ttl):
    set_at, hits = {}, {}
    for user, event, t in sorted(rows, key=lambda r: (r[2], r[1])):
        hits[event] = user in set_at and t <= set_at[user] + ttl
        if not hits[event]:
            set_at[user] = t
    return hits


def test_entries_are_not_renewed(spark):
    hour = 3600
    rows = [(1, 1, 0), (1, 2, 20 * hour), (1, 3, 40 * hour), (1, 4, 64 * hour), (1, 5, 64 * hour + 1), (2, 6, 5), (None, 7, 0), (None, 8, 1)]
    rnd = random.Random(1)
    rows += [(rnd.choice([3, 4, 5]), 100 + i, rnd.randrange(0, 3000) * 600) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts")
    got = {r["event_id"]: r["hit"] for r in usage.expiring_calls(df, "user_id", 86_400).collect()}
    want = plain_entries(rows, 86_400)
    assert got == want and [want[i] for i in range(1, 9)] == [False, True, False, True, False, False, False, True]
    none = spark.createDataFrame([(1, 1, None), (1, 2, 5)], "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts")
    assert {r["event_id"]: r["hit"] for r in usage.expiring_calls(none, "user_id", 60).collect()} == {1: False, 2: False}


def files(spark, tmp_path, batches, schema, start=0):
    """A stream of one file a batch, in order; start: files that are there already."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches, start):
        spark.createDataFrame(rows, schema).selectExpr("* except (s)", "timestamp_seconds(s + 1000000) AS ts").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        folder.mkdir(exist_ok=True)
        (part,) = (tmp_path / f"part{i}").glob("*.parquet")
        part.rename(folder / f"b{i:03}.parquet")
        os.utime(folder / f"b{i:03}.parquet", (1_000_000 + 10 * i, 1_000_000 + 10 * i))
    return stream.source(spark, str(folder))


def test_stream_of_entries_over_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = sorted([(rnd.choice([1, 2, 3]), i, rnd.randrange(0, 40) * 3600) for i in range(120)], key=lambda r: (r[2], r[1]))
    batches = [rows[i : i + 30] for i in range(0, 120, 30)]
    got = {r["event_id"]: r["hit"] for r in stream.drain(stream.expiring(files(spark, tmp_path, batches, "user_id long, event_id long, s long"), 7200.0)).collect()}
    assert got == plain_entries(rows, 7200) and any(got.values())


def test_stream_limiter_over_batches_forgets_idle_users(spark, tmp_path):
    batches = [[(1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 4, 0)], [(1, 5, 55), (1, 6, 61)], [(3, 7, 90_000)], [(3, 8, 90_001), (1, 9, 89_990)], [(2, 10, 50)]]
    done = stream.drain(stream.limiter(files(spark, tmp_path, batches, "user_id long, event_id long, s long"), 60.0, 2))
    # the call of event 10 is behind the watermark of the batch before; that of 9 is late and within it
    assert listed(done, "event_id", "allowed") == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True), (8, True), (9, True)]


def test_versions_of_a_table_replay(spark, tmp_path):
    path = str(tmp_path / "kept")
    schema = "user_id long, event_id long, s long"
    read = files(spark, tmp_path, [[(1, 1, 0), (2, 2, 0)], [(1, 3, 5)]], schema)
    stream.upserted(read, "user_id", path)
    latest = [(1, 3), (2, 2)]
    assert listed(stream.current(spark, path), "user_id", "event_id") == latest and stream.version(spark, path) == 1
    # a last batch whose end was never recorded comes again, and changes nothing
    for name in ("1", ".1.crc"):
        (tmp_path / "kept" / "checkpoint" / "commits" / name).unlink()
    stream.upserted(read, "user_id", path)
    assert listed(stream.current(spark, path), "user_id", "event_id") == latest and stream.version(spark, path) == 1
    # after a restart numbers go on, and what is new is merged
    files(spark, tmp_path, [[(2, 9, 9), (4, 4, 1)]], schema, 2)
    stream.upserted(read, "user_id", path)
    assert listed(stream.current(spark, path), "user_id", "event_id") == [(1, 3), (2, 9), (4, 4)]


def test_response_cache_over_batches(spark, tmp_path):
    schema = "event_id long, kind string, key string, document string, answer string, s long"
    events = [(1, "call", "k", "d", "one", 1), (2, "call", "k", "d", "two", 2), (3, "call", "m", "e", "m1", 2), (4, "change", None, "d", None, 3), (5, "call", "k", "d", "three", 4), (6, "call", "m", "e", "m2", 5), (7, "change", None, "e", None, 6), (8, "call", "k", "d", "four", 7)]
    for cut in ([8], [2, 8], [3, 4, 5, 8], list(range(1, 9))):
        batches = [events[i:j] for i, j in zip([0, *cut], cut)]
        at = tmp_path / str(len(cut)) / str(cut[0])
        at.mkdir(parents=True)
        stream.response_cache(files(spark, at, batches, schema), str(at / "cache"), "change")
        rows = listed(stream.current(spark, str(at / "cache")), "key", "document", "answer", "hits")
        assert rows == [("k", "d", "three", 1)]


# --- halves, empty fields, providers


def test_missing_scores_count_nothing(spark):
    keyword = spark.createDataFrame([(1, "a", 0.3), (1, "b", 0.0)], "doc_id long, doc_type string, score double")
    none = spark.createDataFrame([], "doc_id long, doc_type string, score double")
    for other in (None, none):
        assert classify.decided(keyword, other).first()["confidence"] == 0.5
    assert classify.decided(keyword, keyword).first()["confidence"] == 1.0


def test_empty_lists_are_empty(spark):
    df = spark.createDataFrame([(1, "", [], None, {}), (2, "x", [None], 0.0, None)], "k int, a string, b array<string>, c double, d map<string,string>")
    assert listed(extraction.empty_fields(df, "k", ["a", "b", "c", "d"]), "k", "field") == [(1, "a"), (1, "b"), (1, "c"), (2, "d")]


def counting(path, error=""):
    """A provider that writes down each prompt that it is asked, and fails twice if it has an error."""

    class Counting:
        def answer(self, prompts):
            with open(path, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            if error and sum(1 for _ in open(path)) < 3:
                raise RuntimeError(error)
            return [p.upper() for p in prompts]

    return Counting()


def test_a_provider_sees_each_prompt_once(spark, tmp_path):
    calls = spark.createDataFrame([(i, "u", "m", "s", t) for i, t in enumerate(["a", "b", "a", "c", "b"])], "id long, user string, model string, system string, text string")
    key = spark.createDataFrame([("c",)], "t string").selectExpr("sha2('u|p|m|s|c', 256) AS key", "'known' AS answer")
    answers, new = adapters.through_cache(calls, key, counting(tmp_path / "asked"), "p")
    for _ in range(2):
        assert listed(answers, "id", "answer", "hit") == [(0, "A", False), (1, "B", False), (2, "A", False), (3, "known", True), (4, "B", False)]
        assert listed(new, "answer") == [("A",), ("B",)]
    assert sorted(open(tmp_path / "asked").read().split()) == ["a", "b"]
    other = adapters.through_cache(calls, key, counting(tmp_path / "other"), "q")[0]
    assert other.filter("hit").count() == 0


@pytest.mark.parametrize("error, tries, answer", [("429 Too Many", 3, "P"), ("Rate limit", 3, "P"), ("refused", 1, None)])
def test_only_rate_limits_are_tried_again(spark, tmp_path, error, tries, answer):
    prompts = spark.createDataFrame([("k", "p")], "key string, prompt string")
    row = adapters.answered(prompts, counting(tmp_path / "asked", error), wait=0.01).first()
    assert (row["answer"], row["error"]) == (answer, None if answer else error)
    assert len(open(tmp_path / "asked").read().split()) == tries
